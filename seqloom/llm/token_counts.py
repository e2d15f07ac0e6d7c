"""Token counts of whole texts: pieces are counted once per distinct pre-token and joined to the documents' frequencies."""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Pre-tokens that travel to all tasks, at most (see token_counts), and the characters above which one goes as a digest.
FREQUENT, LONGEST = 1 << 17, 32
#: Distinct pre-tokens that a task holds before it hands their counts on, characters looked at in one step, and
#: characters of pre-tokens that are given to the tokenizer at once.
HELD, STEP, AT_ONCE = 1 << 18, 1 << 20, 1 << 20
SPACE = "▁"


class PreTokens:
    """Cuts texts for a sentencepiece BPE model wherever no piece of its vocabulary holds the two characters that meet
    there. No merge can cross such a place, so the pieces of a text are the pieces of its pre-tokens.

    Models whose pieces depend on more than that (unigram models, normalisers that rewrite text, user-defined symbols,
    white space as a suffix, collapsed spaces) are refused.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        how, kinds = model.normalizer_spec, model.SentencePiece
        fits = model.trainer_spec.model_type == model.trainer_spec.BPE and not model.trainer_spec.treat_whitespace_as_suffix
        plain = not how.precompiled_charsmap and not how.remove_extra_whitespaces and how.escape_whitespaces
        if not fits or not plain or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("only BPE models that leave the text as it is and have no user-defined symbols are counted by pre-token")
        pieces = [p.piece.replace(SPACE, " ") for p in model.pieces if p.type == kinds.NORMAL]
        self.prefix = " " if how.add_dummy_prefix else ""
        chars = sorted(set("".join(pieces)))
        known = {c: i + 1 for i, c in enumerate(chars)}
        self.kind = np.zeros(0x110000, np.int32)  # characters of no piece are 0
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.together = np.zeros(self.width * self.width, bool)
        self.together[[known[a] * self.width + known[b] for p in pieces for a, b in zip(p, p[1:])]] = True
        self.guard = next(c for c in map(chr, range(10, 0x110000)) if c not in known)  # merges with nothing
        self.encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
        self.before = len(self.encode(self.guard))

    def __call__(self, text: str) -> list[str]:
        """The pre-tokens in their order; spaces stand for the model's own space character. Empty texts have none."""
        if not text:
            return []
        text, cuts = self.prefix + text.replace(SPACE, " "), [0]
        for lo in range(0, len(text), STEP):
            kind = self.kind[np.frombuffer(text[lo : lo + STEP + 1].encode("utf-32-le"), np.uint32)]
            cuts += (np.flatnonzero(~self.together[kind[:-1] * self.width + kind[1:]]) + (lo + 1)).tolist()
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]

    def count(self, pre_tokens: list[str]) -> list[int]:
        """The number of pieces of every pre-token, behind a character that keeps the model's prefix away from it."""
        out, at, size = [], 0, 0
        for i, p in enumerate(pre_tokens, 1):
            size += len(p)
            if size >= AT_ONCE or i == len(pre_tokens):
                out += [len(ids) - self.before for ids in self.encode([self.guard + x for x in pre_tokens[at:i]], num_threads=1)]
                at, size = i, 0
        return out


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def _seen(path: str):
    """Distinct pre-tokens of a task and how often they occur."""

    def run(batches):
        split, found = pre_tokens(path), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(split(text))
                if len(found) >= HELD:
                    yield from _frequencies(found)
                    found = Counter()
        yield from _frequencies(found)

    return run


def _frequencies(found: Counter):
    names, n = list(found), list(found.values())
    for lo in range(0, len(names), 1 << 15):
        yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + (1 << 15)], pa.string()), pa.array(n[lo : lo + (1 << 15)], pa.int64())], ["pre_token", "n"])


def _pieces(path: str):
    def run(batches):
        for batch in batches:
            pieces = pre_tokens(path).count(batch.column("pre_token").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("pre_token"), batch.column("n"), pa.array(pieces, pa.int64())], ["pre_token", "n", "pieces"])

    return run


def distinct_pre_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(pre_token, n, pieces): the distinct pre-tokens of all texts, how often they occur, and their pieces."""
    texts = docs.select("text").where(F.length("text") > 0)
    found = texts.mapInArrow(_seen(path), "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    return found.mapInArrow(_pieces(path), "pre_token string, n long, pieces long")


def _name(pre_token: str):
    return pre_token if len(pre_token) <= LONGEST else hashlib.blake2b(pre_token.encode(), digest_size=16).digest()


def _frequent(distinct: DataFrame, most: int) -> dict:
    """Pieces of the most frequent pre-tokens, `most` at most: those above a frequency, taken from a histogram of
    frequencies (sixteen bins to a doubling), so that no list longer than the answer is gathered."""
    bin_ = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(distinct.groupBy(bin_.alias("bin")).count().collect(), reverse=True)
    total = np.cumsum([r["count"] for r in sizes])
    within = int(np.searchsorted(total, most, side="right"))
    if not within:
        return {}
    short = F.length("pre_token") <= LONGEST
    rows = distinct.where(bin_ >= sizes[within - 1]["bin"])
    # long ones come as what _name gives for them, computed where they are
    short_rows = rows.where(short).select("pre_token", "pieces").collect()
    named = rows.where(~short).select("pre_token", "pieces").mapInArrow(_named, "name binary, pieces long").collect()
    return {r[0]: r[1] for r in short_rows} | {bytes(r[0]): r[1] for r in named}


def _named(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(map(_name, batch.column("pre_token").to_pylist()), pa.binary()), batch.column("pieces")], ["name", "pieces"])


def _documents(path: str, frequent):
    """Per document: the pieces of its frequent pre-tokens, and the frequencies of its other ones."""
    rest = pa.list_(pa.struct([("pre_token", pa.string()), ("times", pa.int64())]))

    def run(batches):
        split, known = pre_tokens(path), frequent.value
        for batch in batches:
            pieces, others = [], []
            for text in batch.column("text").to_pylist():
                total, other = 0, []
                for p, n in Counter(split(text)).items():
                    own = known.get(p if len(p) <= LONGEST else _name(p))
                    if own is None:
                        other.append({"pre_token": p, "times": n})
                    else:
                        total += own * n
                pieces.append(total)
                others.append(other)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(pieces, pa.int64()), pa.array(others, rest)], ["doc_id", "n_bytes", "pieces", "rest"])

    return run


def token_counts(docs: DataFrame, path: str, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row: UTF-8 bytes of the whole text and its number of pieces, no ids made.

    Texts are cut into pre-tokens twice. The first pass gathers the distinct ones, and the model counts each of them
    once. In the second, a document's frequencies meet those counts: the `frequent` most frequent pre-tokens (a fixed
    number of short keys, long ones as 16-byte digests, some MB) go to all tasks; all others are joined by a shuffle, in
    which no key holds more than about 1 / frequent of the occurrences. What the second pass leaves to the join is a
    written table, so the numbers that tell its rows apart stay the same when work is done again.

    Null and empty texts have 0 bytes and 0 tokens; null ids stay; repeated rows are counted each; a very long text is
    counted whole in one task; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    distinct = cut(distinct_pre_tokens(rows, path))
    known = spark.sparkContext.broadcast(_frequent(distinct, frequent))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    seen = sized.mapInArrow(_documents(path, known), f"doc_id {kind}, n_bytes long, pieces long, rest array<struct<pre_token string, times long>>")
    seen = cut(seen.withColumn("row", F.monotonically_increasing_id()))
    rest = seen.select("row", F.inline("rest")).join(distinct.select("pre_token", F.col("pieces").alias("each")), "pre_token")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("each")).alias("others"))
    tokens = F.col("pieces") + F.coalesce("others", F.lit(0).cast("long"))
    return seen.drop("rest").join(rest, "row", "left").select("doc_id", "n_bytes", tokens.alias("n_tokens"))


def query(spark, sf_dir):
    import public_tokenizers

    from .common import bounded_batches, read

    bounded_batches(spark)
    counted = token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
