"""Token counts: pieces per distinct pre-token, joined to per-document pre-token frequencies.

Texts are cut into units (white space with the word after it, marks apart), which are numbered by
Arrow's dictionary encoding; the tokenizer's own splitting rule cuts each distinct unit into
pre-tokens. It breaks wherever one unit ends, so the pre-tokens of a text are those of its units.
Special strings of the tokenizer are cut out first and count one each, as the library does by
default.

Distinct pre-tokens are counted over the whole corpus and their pieces counted once. Frequent
ones, at most ``hot`` (a fixed bound), are sent to every task, which sums their pieces on the spot;
the rest go through a shuffled join, in which a long one is its SHA-256. Of these, too, some may be
common (a ruler of eighty hyphens in every text): keys with a share of the rest's occurrences are
joined where their rows are. So neither a frequent nor a rare pre-token is dropped and no key of the
shuffle is hot. What a document has in hand stays out of that join. Token ids are never kept.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows and ids each give a row; an empty table
gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from filequarry.llm.common import join_hot, joined_batches, slices, small_batches, units_of, written

#: Frequent pre-tokens sent to each task, and the longest of them in characters.
HOT, HOT_CHARS = 200_000, 64
#: Distinct pre-tokens and units a task holds before it hands on its counts or starts anew.
HELD = 300_000
TEXT_BYTES = 2 << 20
#: One pre-token to any rule of this kind: letters of Latin-1, a space before them or none.
WORD = re.compile(r" ?[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+")

_loaded: dict = {}


class Rule:
    """A tokenizer's special strings, its splitting rule, and its pieces of a pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = list(self.tok.get_added_tokens_decoder().values())
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("added tokens that touch their surroundings can't be counted apart")
        strings = sorted((t.content for t in added), key=lambda s: (-len(s), s))
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.split = self.tok.pre_tokenizer.pre_tokenize_str
        self.form = {c: "".join(x for x, _ in self.split(chr(c))) for c in (32, *range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if WORD.fullmatch(" " + chr(c)) or c == 32}

    def pre_tokens(self, unit: str) -> list[str]:
        if WORD.fullmatch(unit):
            return [unit]
        return [unit[a:b] for _, (a, b) in self.split(unit)]

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        """Tokens of each; words of letters go straight to the model, as nothing else applies to them."""
        out, rest = [0] * len(pre_tokens), []
        for k, u in enumerate(pre_tokens):
            if self.tok.normalizer is None and WORD.fullmatch(u):
                out[k] = len(self.tok.model.tokenize(u.translate(self.form)))
            else:
                rest.append(k)
        for k, e in zip(rest, self.tok.encode_batch_fast([pre_tokens[k] for k in rest], add_special_tokens=False)):
            out[k] = len(e.ids)
        return out


def load(path: str) -> Rule:
    if path not in _loaded:
        _loaded[path] = Rule(path)
    return _loaded[path]


def parts_of(texts: pa.Array, special: re.Pattern | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts without special strings, which text each part is of, and each text's number of them."""
    n = len(texts)
    if special is None or not pc.any(pc.match_substring_regex(texts, special.pattern)).as_py():
        return texts, np.arange(n), np.zeros(n, np.int64)
    cut = [special.split(t) if t else [""] for t in texts.to_pylist()]
    many = np.fromiter(map(len, cut), np.int64, n)
    return pa.array([p for ps in cut for p in ps], pa.string()), np.repeat(np.arange(n), many), many - 1


def pre_token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """unit, n: every distinct pre-token of the corpus with its number of occurrences."""

    def count(batches):
        rule, held = load(path), Counter()

        def flush():
            out = pa.record_batch({"unit": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return out

        for part in joined_batches(batches, "text", TEXT_BYTES):
            units, unit, _ = units_of(parts_of(part.column("text"), rule.special)[0])
            for u, n in zip(units, np.bincount(unit, minlength=len(units)).tolist()):
                if WORD.fullmatch(u):
                    held[u] += n
                else:
                    for t in rule.pre_tokens(u):
                        held[t] += n
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()

    found = docs.select(F.col(text).alias("text")).mapInArrow(count, "unit string, n long")
    return found.groupBy("unit").agg(F.sum("n").alias("n"))


def piece_counts(units: DataFrame, path: str) -> DataFrame:
    """Adds pieces, the tokens of each distinct pre-token, counted once each."""

    def encode(batches):
        rule = load(path)
        for part in slices(batches, "unit"):
            got = rule.pieces(part.column("unit").to_pylist())
            yield pa.record_batch({"unit": part.column("unit"), "n": part.column("n"), "pieces": pa.array(got, pa.int64())})

    return units.mapInArrow(encode, "unit string, n long, pieces long")


def join_key(unit: str) -> str:
    return unit if len(unit) <= HOT_CHARS else hashlib.sha256(unit.encode()).hexdigest() + "+"


def key_of(unit: Column) -> Column:
    """As :func:`join_key`; a digest is longer than any unit that stands for itself."""
    return F.when(F.length(unit) <= HOT_CHARS, unit).otherwise(F.concat(F.sha2(unit, 256), F.lit("+")))


class Known:
    """Of each unit met: the pieces of its frequent pre-tokens, and the join keys of the others."""

    def __init__(self, rule: Rule, pieces: dict[str, int]):
        self.rule, self.pieces = rule, pieces
        self.index, self.sure, self.rest = {}, np.empty(0, np.int64), {}

    def __call__(self, units: list[str]) -> np.ndarray:
        """Places of distinct ``units``."""
        if len(self.index) > HELD:
            self.index, self.sure, self.rest = {}, np.empty(0, np.int64), {}
        new = [u for u in units if u not in self.index]
        sure = []
        for at, u in enumerate(new, len(self.index)):
            got = self.pieces.get(u) if WORD.fullmatch(u) else None
            if got is None:
                pre = self.rule.pre_tokens(u)
                others = [t for t in pre if t not in self.pieces]
                got = sum(self.pieces[t] for t in pre if t in self.pieces)
                if others:
                    self.rest[at] = list(map(join_key, others))
            sure.append(got)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.sure = np.concatenate([self.sure, np.array(sure, np.int64)])
        return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """id_column, n_bytes (UTF-8), n_tokens: one row for each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = written(piece_counts(pre_token_counts(docs, path, text), path), "pre-tokens")
    # a cut in frequency that at most ``hot`` pass: ordering with a limit would bring that many of each partition to the driver
    step = F.floor(F.log2("n") * 16)
    short = pieces.filter(F.length("unit") <= HOT_CHARS).withColumn("step", step)
    least, left = None, hot
    for r in short.groupBy("step").count().orderBy(F.desc("step")).collect():  # a thousand steps at most
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    sent = (F.length("unit") <= HOT_CHARS) & (step >= (1 << 40 if least is None else least))
    top = pieces.filter(sent).select("unit", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column("unit").to_pylist(), top.column("pieces").to_pylist())))

    def spread(batches):
        rule, part_id, row = load(path), TaskContext.get().partitionId(), 0
        of = Known(rule, known.value)
        for part in joined_batches(batches, "text", TEXT_BYTES):
            texts, owner, specials = parts_of(part.column("text"), rule.special)
            units, unit, bounds = units_of(texts)
            at = of(units)[unit]
            text_of = np.repeat(owner, np.diff(bounds))
            n = len(specials)
            sure = specials + np.bincount(text_of, weights=of.sure[at], minlength=n).astype(np.int64)
            size = pc.fill_null(pc.binary_length(part.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            key = (part_id << 33) + row + np.arange(n)
            row += n
            yield pa.record_batch({"key": pa.array(key), "id": part.column("id"), "n_bytes": pa.array(size), "unit": pa.nulls(n, pa.string()), "n": pa.array(sure)})
            open_ = np.zeros(len(of.sure), bool)
            open_[list(of.rest)] = True
            rare = np.flatnonzero(open_[at])
            if len(rare):
                found = Counter((k, t) for k, a in zip(key[text_of[rare]].tolist(), at[rare].tolist()) for t in of.rest[a])
                keys, rest = zip(*found)
                m = len(keys)
                yield pa.record_batch({"key": pa.array(keys, pa.int64()), "id": pa.nulls(m, part.schema.field("id").type), "n_bytes": pa.nulls(m, pa.int64()), "unit": pa.array(rest, pa.string()), "n": pa.array(found.values(), pa.int64())})

    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    parts = written(rows.mapInArrow(spread, f"key long, id {kind}, n_bytes long, unit string, n long"), "frequencies")
    base = parts.filter("unit IS NULL").select("key", "id", "n_bytes", "n")
    others = pieces.filter(~sent).select(key_of(F.col("unit")).alias("unit"), "pieces", F.col("n").alias("weight"))
    rest = join_hot(parts.filter("unit IS NOT NULL"), others, ["unit"], "weight")
    rest = rest.groupBy("key").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    tokens = F.col("n") + F.coalesce("more", F.lit(0))
    return base.join(rest, "key", "left").select(F.col("id").alias(id_column), "n_bytes", tokens.alias("n_tokens"))
