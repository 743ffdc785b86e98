"""Token-ID output: Parquet list columns that allow selective token and metadata reads.

Rows lie in ascending id order over the files. Each file has doc_id, block, start_in_block and
n_tokens (delta encoded) and ids (dictionary encoded: a column chunk has few distinct ids), row
groups and pages of set sizes, and the page index that lets a reader skip pages by doc_id.
``start`` of a document, the ids of all documents before it, is its start in the block plus the
totals of earlier blocks; it needs the metadata columns only.

Units, white space with the word after it and marks apart, are found in the text's bytes, numbered
by Arrow's dictionary encoding, encoded by the library once per task and remembered within a bound:
the tokenizer drops white space and breaks wherever one unit ends, so the ids of a text are those
of its units in turn.

Null text is empty: only the end id is written. Rows with equal ids stay apart, ordered by text;
a null id sorts first. An empty table gives an empty folder that reads as no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from filequarry.llm.common import joined_batches, scratch_path, shuffle_partitions, small_batches, units_of

#: Distinct units a task remembers, and how many of the first (the frequent ones) it keeps when full.
HELD, KEPT = 600_000, 400_000
#: Text bytes encoded at a time: the more, the fewer distinct units are looked up again.
ENCODED_BYTES = 4 << 20
ROW_GROUP_BYTES, PAGE_BYTES = 8 << 20, 64 << 10
SCHEMA = "doc_id long, block int, start_in_block long, n_tokens int, ids array<int>"

#: White space and Latin-1 letters: no normalization but the case, and no break inside.
LETTERS = re.compile(r"[\x20\x09-\x0D]*[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+")

_loaded: dict = {}


def gather(flat: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``at`` of ``flat``, cut by ``length``, in turn, and their lengths."""
    own = length[at]
    first = (np.cumsum(length) - length)[at]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(first - (ends - own), own)], own


class UnitEncoder:
    """Ids of units; a distinct unit goes through the library once while it is remembered."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(t.content) for t in added.values())) if added else None
        # a special string between units keeps them apart in one call; one call for each unit costs far more
        self.between = next(((i, t.content) for i, t in sorted(added.items()) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        # the bytes of a letter as the model knows them
        form = self.tok.pre_tokenizer.pre_tokenize_str
        self.letters = {c: "".join(x for x, _ in form(chr(c))) for c in range(0xAA, 0x100) if chr(c).isalpha() and chr(c).islower()}
        # the first entry stands for the end of a text
        self.index, self.length, self.flat = {None: 0}, np.ones(1, np.int64), np.array([end_id], np.int32)

    def forget(self):
        self.index = dict(list(self.index.items())[:KEPT])
        self.length = self.length[:KEPT]
        self.flat = self.flat[: int(self.length.sum())]

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``units`` in turn and the number of ids of each."""
        alone = not self.between or self.special.search(" ".join(units))
        if alone:
            got = [e.ids for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]
            return np.fromiter((i for ids in got for i in ids), np.int32), np.fromiter(map(len, got), np.int64, len(got))
        mark, string = self.between
        ids = np.array(self.tok.encode_batch_fast([string.join(units)], add_special_tokens=False)[0].ids, np.int32)
        at = np.flatnonzero(ids == mark)
        return np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1

    def words(self, units: list[str]) -> tuple[list[int], list[int]]:
        """As ``encode`` for units of Latin-1 letters: one pre-token each, so the model alone is asked."""
        ids, length = [], []
        for u in units:
            u = u.strip().lower()
            got = self.tok.model.tokenize(u if u.isascii() else u.translate(self.letters))
            ids += [t.id for t in got]
            length.append(len(got))
        return ids, length

    def places(self, units: list[str]) -> np.ndarray:
        """Where each of the distinct ``units`` is held."""
        if len(self.index) > HELD:
            self.forget()
        plain, new = [], []
        for u in units:
            if u not in self.index:
                (plain if LETTERS.fullmatch(u) else new).append(u)
        if plain or new:
            got = [self.words(plain), *(self.encode(new[k : k + 2000]) for k in range(0, len(new), 2000))]
            ids, length = (np.concatenate([np.array(x, np.int64) for x in xs]) for xs in zip(*got))
            self.index.update(zip((*plain, *new), range(len(self.index), len(self.index) + len(length))))
            self.length = np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))


def encode_texts(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts with the end id after each, and the number of ids of each text.

    A-Z are lower-cased before, as the tokenizer does, so fewer units are distinct; not in texts
    where that could make up a special string.
    """
    if (path, end_id) not in _loaded:
        _loaded[path, end_id] = UnitEncoder(path, end_id)
    encoder = _loaded[path, end_id]
    units, unit, bounds = units_of(texts, pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False))
    at = np.insert(encoder.places(units)[unit], bounds[1:], 0)
    ids, length = gather(encoder.flat, encoder.length, at)
    ends = np.cumsum(length)[bounds[1:] + np.arange(len(texts))]
    return ids, np.diff(ends, prepend=0)


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int, id_column: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write the files under ``out``."""
    spark = docs.sparkSession
    small_batches(spark)

    def encode(batches):
        block, at = TaskContext.get().partitionId(), 0
        for part in joined_batches(batches, "text", ENCODED_BYTES):
            ids, n = encode_texts(part.column("text"), path, end_id)
            ends = np.concatenate([[0], np.cumsum(n)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "block": pa.array(np.full(len(n), block), pa.int32()), "start_in_block": pa.array(at + ends[:-1], pa.int64()), "n_tokens": pa.array(n, pa.int32()), "ids": lists})
            at += int(ends[-1])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "parquet.writer.version": "v2",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "start_in_block", "n_tokens")},
        "compression": "zstd",
    }
    rows.mapInArrow(encode, SCHEMA).write.options(**options).parquet(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids, from the files."""
    files = spark.read.schema(SCHEMA).parquet(out)
    blocks = files.groupBy("block").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    # one row per file: as many as the writer had partitions
    before = F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("block", before.alias("before"))
    return files.join(F.broadcast(starts), "block").select("doc_id", (F.col("before") + F.col("start_in_block")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian 32-bit integers."""

    def digest(batches):
        for b in batches:
            ids = b.column("ids")
            values = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
            crc = [zlib.crc32(values[s:e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "start": b.column("start"), "n_tokens": b.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())})

    return tokens.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    """Write ``docs`` as token files (in the shared folder if ``out`` is None); digests read back from them."""
    out = out or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, out, path, end_id)
    return token_digests(read_tokens(docs.sparkSession, out))
