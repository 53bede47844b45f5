"""BPE encoding and decoding with a published tokenizer file.

Each word is a doubly linked list of symbols. A heap holds the possible merges by rank and place;
an entry whose symbols have changed since it was pushed is stale and skipped. Words repeat, so the
result for a word is kept in a table per task, bounded by CACHE_WORDS. Without a decoder in the file, decoding is
the vocabulary strings of the ids joined by spaces, as the file's own library does.

Defined results: null and empty texts have no ids and decode to an empty text; a null list of ids
decodes to null; extra columns are dropped unless named in `keep`; an empty table stays empty; a text is never cut,
whatever its length.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, functions as F, types as T

from panelcast.llm.common import map_texts

CACHE_WORDS = 150_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A BPE with word-end symbols, read from a tokenizer JSON file of the kind named in `check`."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.check(spec)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        # A pair of ids is one integer key; a merge is found by its rank.
        self.rank: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(self.vocab[a] << 32 | self.vocab[b], len(self.merges))
            self.merges.append((self.vocab[a], self.vocab[b], self.vocab[a + b]))
        parts = spec["pre_tokenizer"]["pretokenizers"]
        # White space by its Unicode property, as the file's regular expressions mean it.
        self.words = regex.compile(parts[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall
        self.blank = regex.compile(r"\p{White_Space}+")
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.inner = [self.vocab[s] for s in byte_symbols()]
        self.last = [self.vocab[s + self.suffix] for s in byte_symbols()]
        self.known: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def check(spec: dict) -> None:
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        parts = [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        if spec["model"]["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or parts != ["Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError("this tokenizer file has other steps than NFC, blanks, lower case, split, byte-level BPE without decoder")

    def normalise(self, text: str) -> str:
        text = self.blank.sub(" ", unicodedata.normalize("NFC", text))
        return text.replace("Σ", "σ").lower()  # letter by letter: no final sigma

    def encode_word(self, word: str) -> tuple[int, ...]:
        spelled = word.encode()
        ids = [self.inner[b] for b in spelled]
        n = len(ids)
        ids[-1] = self.last[spelled[-1]]
        if n == 1:
            return (ids[0],)
        rank, merges, push, pop = self.rank.get, self.merges, heapq.heappush, heapq.heappop
        # Queue entries are rank << 32 | place: the lowest rank first, then the leftmost place.
        queue = [r << 32 | i for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            a, b, merged = merges[entry >> 32]
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale: one of its symbols has been merged since
            ids[i], ids[j] = merged, -1
            after = right[i] = right[j]
            if after >= 0:
                left[after] = i
                if (r := rank(merged << 32 | ids[after])) is not None:
                    push(queue, r << 32 | i)
            before = left[i]
            if before >= 0 and (r := rank(ids[before] << 32 | merged)) is not None:
                push(queue, r << 32 | before)
        return tuple([x for x in ids if x >= 0])

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for part in self.cut(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for word in self.words(self.normalise(part)):
                found = known.get(word)
                if found is None:
                    found = self.encode_word(word)
                    if len(known) < CACHE_WORDS and len(word) <= 64:
                        known[word] = found  # frequent words come early; the table is never emptied
                out += found
        return out

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=4)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """`keep` (default doc_id), ids array<int>, and with decoded=True the decoded text of those ids.

    path: a tokenizer file that every executor has, as part of its installation.
    """

    def work(texts: list[bytes]) -> list[list]:
        bpe = loaded(path)
        ids = [bpe.encode(t.decode()) for t in texts]
        return [ids, [bpe.decode(x) for x in ids]] if decoded else [ids]

    fields = "ids array<int>" + (", decoded string" if decoded else "")
    return map_texts(docs, text, keep or ["doc_id"], fields, work, done=lambda: loaded(path).known.clear())


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns, with `decoded` added (replaced if there is one)."""

    @F.pandas_udf(T.StringType())
    def strings(column):
        bpe = loaded(path)
        return column.map(lambda x: None if x is None else bpe.decode(x.tolist()))

    return encoded.withColumn("decoded", strings(F.col(f"`{ids}`")))
