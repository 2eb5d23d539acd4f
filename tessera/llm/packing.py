"""Best-fit-decreasing packing of tokenised documents into sequences of at most ``capacity`` tokens.

Best fit decreasing depends on lengths alone, and there are at most ``capacity`` of those. So the plan is made over their
counts: bins with equal contents form a group, and a segment tree over remaining capacities finds the tightest open
group in logarithmic time; a length has all its pieces dealt in a few steps, with the bins that a document-by-document
run would choose. The plan's size depends on the capacity, not on the number of documents. Each piece then looks up
its place by its length and its rank among the pieces of that length.

Styles: tokenising and the lookup are Python on Arrow batches; ranks are DataFrame functions.

Defined results: a null text is empty, an empty text is the closing id alone; repeated rows are packed each; ties of
length follow doc_id, piece and checksum; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
Texts of any length are tokenized whole, and only documents of over 2048 ids are cut."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import running_offsets, table, written

CAPACITY, CLOSING_ID, RANK_PART_ROWS, CACHED_WORDS = 2048, 0, 100_000, 600_000


LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
LATIN_PLAIN = "".join(c for c in map(chr, range(0xC0, 0x250)) if re.fullmatch(f"[{LATIN}]", c) and re.fullmatch(f"[{LATIN}]", c.lower()))
#: Byte-level models write a byte as a letter: printable ones as themselves, the others as letters from U+0100 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES_AS_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


class Store(dict):
    """Ids of words. A missing word is taken from the older half of the store or from the model; when this half is full it becomes the
    older one, so frequent words stay and the store stays bounded."""

    def __init__(self, model, half: int) -> None:
        super().__init__()
        self.tokenize, self.half, self.older = model.tokenize, half, {}

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(BYTES_AS_LETTERS)
            ids = [t.id for t in self.tokenize(shown)]
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[word] = got
        return got


class Words:
    """Ids of a text, as little-endian unsigned 32-bit bytes, by way of the ids of its words.

    Texts of ASCII and Latin letters alone are cut into the tokenizer's own words here, and words are looked up or go to its model; any other text goes
    to the tokenizer as a whole. A capital is in LATIN_PLAIN only if its small form is a letter of LATIN too, since texts
    are cut in small letters."""

    PLAIN = re.compile(f"[A-Za-z{LATIN_PLAIN}\x20-\x7e\t-\r]*")
    CUT = re.compile(f"[{LATIN}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\s{LATIN}0-9]+")

    def __init__(self, path: str, most: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Store(self.tokenizer.model, most // 2)
        self.close = np.uint32(CLOSING_ID).astype("<u4").tobytes()

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        get, cut, plain = self.known.__getitem__, self.CUT.findall, self.PLAIN.fullmatch
        for text in texts:
            if "<|" not in text and plain(text):
                yield b"".join(map(get, cut(text.lower()))) + self.close
            else:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.close


_STORES: dict[str, Words] = {}


def word_store(path: str) -> Words:
    """The store of this Python process. Spark uses its workers again, so a store serves many tasks; it holds one tokenizer and
    at most ``CACHED_WORDS`` words."""
    if path not in _STORES:
        _STORES.clear()
        _STORES[path] = Words(path)
    return _STORES[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """From doc_id, text: doc_id, piece, start, length, ids_crc32 and, if asked for, ids. Only documents above the capacity are cut."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_store(tokenizer)
        for pdf in batches:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
            for doc, raw in zip(pdf["doc_id"], words.ids([t or "" for t in pdf["text"]]), strict=True):
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, schema)


class Capacities:
    """Segment tree over 0..capacity: the number of open groups at each remaining capacity."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.held = [0] * (2 * self.width)

    def add(self, at: int, by: int) -> None:
        at += self.width
        while at:
            self.held[at] += by
            at //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least that has a group."""
        at = least + self.width
        if self.held[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.held[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.held[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit decreasing over counts of lengths: rows (length, first rank, ranks, first sequence, offset), and the number of sequences.

    A row deals ``ranks`` pieces one each to as many sequences from the first on."""
    open_: dict[int, list[tuple[int, int]]] = {}
    tree, rows, bins = Capacities(capacity), [], 0

    def put(room: int, base: int, n: int) -> None:
        if room and n:
            open_.setdefault(room, []).append((base, n))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, base, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                base, n = open_[room].pop()
                tree.add(room, -1)
            each = room // length  # the fuller bin stays the tightest, so a bin takes all it can before the next one
            full = min(n, left // each)
            for j in range(each if full else 0):
                rows.append((length, rank, full, base, capacity - room + j * length))
                rank += full
            left -= full * each
            put(room - each * length, base, full)
            if full < n:
                for j in range(left):  # fewer than one bin takes
                    rows.append((length, rank + j, 1, base + full, capacity - room + j * length))
                put(room - left * length, base + full, 1 if left else 0)
                put(room, base + full + (1 if left else 0), n - full - (1 if left else 0))
                rank, left = rank + left, 0
    return rows, bins


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """From doc_id, piece, length, ids_crc32 and other columns (a stored table: it is read three times): adds sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most capacity rows
    rows, _ = plan(counts, capacity)
    at = np.array(sorted(rows), np.int64).reshape(-1, 5)
    keys = (at[:, 0] << 44) + at[:, 1]
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(1, -(-sum(counts.values()) // RANK_PART_ROWS))))
    ranked = running_offsets(parts.withColumn("_one", F.lit(1)), ["length"], ["doc_id", "piece", "ids_crc32"], "_one", "_rank", salt).drop("_one")

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["_rank"].to_numpy()
            k = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            yield pdf.drop(columns="_rank").assign(sequence_id=at[k, 3] + rank - at[k, 1], offset=at[k, 4])

    schema = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes) + ", sequence_id long, offset long"
    ids = [n for n, t in parts.dtypes if t == "bigint" and n == "doc_id"]

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (b.astype(dict.fromkeys(ids, "Int64")) for b in look_up(batches))

    return ranked.mapInPandas(kept, schema)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(pieces(docs, tokenizer, capacity), "pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())
