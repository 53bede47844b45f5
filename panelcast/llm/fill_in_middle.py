r"""Fill-in-the-middle documents, cut at unit boundaries that a learned rank index predicts.

A text of n units (`[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+`, left to right) has n + 1 boundaries:
rank 0 at offset 0, rank n at its end. A piecewise-linear index is fitted to rank -> offset: each
segment is the longest run of ranks that one line through its first point meets within BOUND code
points. What is left over is stored, one byte a rank, so that a lookup is a search for the segment, a
multiplication and an exact correction.

Draws are the first four 8-digit groups of the hex sha256 of `42:` and the id. The first two, modulo n + 1,
give the cuts (the smaller one ends the prefix, the larger one the middle), the third decides between a
transformed and a plain text, the fourth between the two orders:
psm is `<P>`prefix`<S>`suffix`<M>`middle, spm `<S>`suffix`<P>`prefix`<M>`middle.

Defined results: null texts are empty; empty texts, texts that contain a marker and those not chosen stay plain, their
cuts null; a null id draws as an empty string; rows with equal ids draw alike; blanks only are one unit;
any cut may be empty (both draws equal, 0 or n); extra columns are dropped unless named in `keep`; an empty
table stays empty; no text is ever cut short.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from panelcast.llm.common import map_texts

MARKERS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
BOUND = 48  # code points between a line and a boundary; residuals need one byte


def boundaries(text: str) -> np.ndarray:
    """The n + 1 offsets between units, in code points."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(1, np.int64)
    blank = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    return np.concatenate([[0], np.flatnonzero(~blank[:-1] & blank[1:]) + 1, [len(codes)]])


class RankIndex(NamedTuple):
    """Segments by first rank, offset there and slope; residuals by rank."""

    starts: np.ndarray
    bases: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.starts, ranks, side="right") - 1
        return self.bases[at] + np.floor(self.slopes[at] * (ranks - self.starts[at])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Exact: what the lines predict, corrected by what is stored."""
        return self.predicted(ranks) + self.residuals[ranks]


def fit_index(offsets: np.ndarray, bound: int = BOUND) -> RankIndex:
    """The greedy longest segments: a line from a segment's first point may have any slope that keeps all
    points so far within the bound, and the segment ends where no slope is left."""
    n, y = len(offsets), offsets.astype(np.float64)
    starts, slopes, start = [], [], 0
    while start < n:
        width = 128
        while True:
            steps = np.arange(1, min(width, n - start))
            rise = y[start + 1 : start + 1 + len(steps)] - y[start]
            low, high = np.maximum.accumulate((rise - bound) / steps), np.minimum.accumulate((rise + bound) / steps)
            fits = int(np.searchsorted(low > high, True))  # once empty, the cone stays empty
            if fits < len(steps) or start + 1 + fits >= n:
                break
            width *= 4
        starts.append(start)
        slopes.append((low[fits - 1] + high[fits - 1]) / 2 if fits else 0.0)
        start += 1 + fits
    index = RankIndex(np.array(starts), offsets[starts], np.array(slopes), np.zeros(0, np.int8))
    return index._replace(residuals=(offsets - index.predicted(np.arange(n))).astype(np.int8))


def rank_index(docs: DataFrame, id: str = "doc_id", text: str = "text", bound: int = BOUND) -> DataFrame:
    """id, n, segments (array of start, base, slope) and residuals (one signed byte a rank) of every text."""
    if not 0 < bound <= 126:
        raise ValueError("residuals are single bytes: choose a bound from 1 to 126")

    def work(texts: list[bytes]) -> list[list]:
        found = [fit_index(boundaries(t.decode()), bound) for t in texts]
        lines = [[{"start": s, "base": b, "slope": m} for s, b, m in zip(i.starts.tolist(), i.bases.tolist(), i.slopes.tolist())] for i in found]
        return [[len(i.residuals) - 1 for i in found], lines, [i.residuals.tobytes() for i in found]]

    fields = "n bigint, segments array<struct<start: bigint, base: bigint, slope: double>>, residuals binary"
    return map_texts(docs, text, [id], fields, work)


def draws(id: str, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit integers for each id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
    seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """keep (the id by default), n, form, prefix_chars, middle_chars, n_segments, output."""

    def work(texts: list[bytes], h1: list[int], h2: list[int], h3: list[int], h4: list[int]) -> list[list]:
        rows = []
        for raw, a, b, c, d in zip(texts, h1, h2, h3, h4):
            whole = raw.decode()
            index = fit_index(boundaries(whole))
            n = len(index.residuals) - 1
            if not whole or c % 100 >= fim_percent or any(m in whole for m in MARKERS):
                rows.append((n, "plain", None, None, len(index.starts), whole))
                continue
            first, second = index.offsets(np.sort(np.array([a % (n + 1), b % (n + 1)]))).tolist()
            prefix, middle, suffix = whole[:first], whole[first:second], whole[second:]
            form, head = ("spm", SUFFIX + suffix + PREFIX + prefix) if d % 100 < spm_percent else ("psm", PREFIX + prefix + SUFFIX + suffix)
            rows.append((n, form, first, second - first, len(index.starts), head + MIDDLE + middle))
        return [list(column) for column in zip(*rows)]

    fields = "n bigint, form string, prefix_chars bigint, middle_chars bigint, n_segments bigint, output string"
    return map_texts(docs, text, [id] if keep is None else keep, fields, work, given=draws(id, seed))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from. No part holds a marker, nor does one arise where parts meet."""
    part = F.split(output, "<[PSM]>", -1)  # psm: '', prefix, suffix, middle; spm: '', suffix, prefix, middle
    return F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2])).when(
        F.col(form) == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.col(output))
