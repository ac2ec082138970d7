"""Operator 11: token counts of whole texts, huge ones in overlapping chunks that are spliced where both sides agree.

Proof of the places where a count may be split, for byte-level BPE without a
normaliser (``proven`` checks the tokenizer file).  Tokens never cross the
words that the pattern ``'(?:[sdmt]|ll|ve|re)| ?\\p{L}+| ?\\p{N}+|
?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` cuts from left to right, and a match
depends on what follows its start alone.

* Fixed places.  No match that holds something else than white space goes on
  into white space, and none of letters or digits into ASCII punctuation; so a
  word of the pattern starts at each white space after something else, and at
  each such mark after a letter or digit.  The apostrophe is left out, and
  texts that hold a special token are cut at white space only.  The pieces
  between fixed places are ``units``; their counts are kept and added up.
* Common places.  A chunk that starts anywhere may cut its first words
  otherwise.  Words of the left chunk that end ``MARGIN`` characters before
  its end are true, if it starts at a true place, since a match looks at no
  more than two characters beyond its end, and a special token is shorter.
  Where a word starts there in the left chunk, and one in the right chunk too,
  both go on alike: the right chunk is true from there on.

Where two chunks have no common place in their overlap (a word without end),
the text is cut again into larger chunks with larger overlaps, until all its
seams hold or one chunk holds it all.
"""

from __future__ import annotations

import json
import os
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import forget, stored
from ._text import batch_of, column_bytes, pieces, worker_caches

#: Characters of a chunk beside its overlap, and of the overlap; both grow by WIDER where a seam fails.
CHUNK, OVERLAP, WIDER = 1 << 15, 1 << 9, 4
#: Units longer than this are cut further, at the words that the library reports.
LONG = 256
#: Counts of units kept by a worker, in two generations of this many.
KEPT_UNITS = 1 << 18

# Letters and digits whose class no version of Unicode disputes, ASCII marks without the apostrophe, white space of all libraries.
_ALNUM = "0-9A-Za-zÀ-ÖØ-öø-ɏ"
_MARKS = r"!-&(-/:-@\[-`{-~"
_SPACE = r"\t-\r "
#: White space elsewhere, or white space for some library only: units after it are not split off.
_UNSURE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_UNITS = re.compile(rf"[{_SPACE}]*+[{_ALNUM}]++(?=[{_MARKS}{_SPACE}]|\Z)|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_UNITS_AT_SPACE = re.compile(rf"(?<=[^\s\u180e\ufeff])(?=[{_SPACE}])")

_kept: dict[str, tuple] = {}
worker_caches.append(_kept)


def load(data: bytes, name: str):
    """The tokenizer of a file's bytes, without truncation or padding: of ``sentencepiece`` for ``.model``, of ``tokenizers`` for all else."""
    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=data)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(data.decode())
    made.no_truncation()
    made.no_padding()
    return made


def proven(data: bytes, name: str) -> list[str] | None:
    """The special tokens of a tokenizer file for which the proof above holds; None for other files, whose texts are encoded whole."""
    if name.endswith(".model"):
        return None
    made = json.loads(data)
    cut, model, added = made.get("pre_tokenizer") or {}, made.get("model") or {}, made.get("added_tokens") or []
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True) and not made.get("normalizer")
    plain &= model.get("type") == "BPE" and not model.get("dropout") and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
    plain &= not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") or a.get("normalized") or re.search(r"\s", a["content"]) for a in added)
    return [a["content"] for a in added] if plain else None


def _counts(model, texts: list[str]) -> list[int]:
    if hasattr(model, "encode_batch_fast"):
        return [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    return [len(x) for x in model.encode(texts, num_threads=1)]


class Counter:
    """Counts of texts whose units have been counted before are sums of looked up numbers."""

    def __init__(self, model, special: list[str]):
        self.model, self.special = model, special
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.long: list[str] = []  # units too long to be kept

    def units(self, text: str) -> list[str]:
        """The text in pieces that start at fixed places."""
        if any(s in text for s in self.special) or _UNSURE.search(text):
            return _UNITS_AT_SPACE.split(text) if text else []
        return _UNITS.findall(text)

    def learn(self, texts: list[list[str]]) -> None:
        """Count the units of some texts that are not known yet, in one call of the library."""
        for u in self.long:
            self.young.pop(u, None)
        if len(self.young) > KEPT_UNITS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for u in set().union(*texts):
            if u not in young:
                if u in old:
                    young[u] = old[u]
                else:
                    new.append(u)
        young.update(zip(new, _counts(self.model, new), strict=True))
        self.long = [u for u in new if len(u) > LONG]

    def counts(self, texts: list[str]) -> list[int]:
        units = [self.units(t) for t in texts]
        self.learn(units)
        return [sum(map(self.young.__getitem__, u)) for u in units]

    def places(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Where words of the pattern start as far as is known, the tokens before each of these places, and all tokens."""
        units = self.units(text)
        self.learn([units])
        at, before, here, n = [], [], 0, 0
        for u in units:
            if len(u) <= LONG:
                at.append(here)
                before.append(n)
            else:
                e = self.model.encode(u, add_special_tokens=False)
                for k, (word, (start, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
                    if not k or word != e.word_ids[k - 1]:
                        at.append(here + start)
                        before.append(n + k)
            here += len(u)
            n += self.young[u]
        return np.array(at, np.int64), np.array(before, np.int64), n


def _counter(data: bytes, name: str, special: list[str]) -> Counter:
    key = f"{name}:{hash(data)}"
    if key not in _kept:
        _kept.clear()
        _kept[key] = Counter(load(data, name), special)
    return _kept[key]


def _texts(column) -> list[str]:
    buf, offs = column_bytes(column)
    data = buf.tobytes()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]


def _whole(batches, key: str, data: bytes, name: str, special: list[str] | None):
    model = load(data, name) if special is None else None
    schema = None
    for piece in pieces(batches, keep_caches=True):
        schema = schema or pa.schema([piece.schema.field(key), pa.field("n_bytes", pa.int64()), pa.field("n_tokens", pa.int64())])
        texts = _texts(piece.column("text"))
        counts = _counts(model, texts) if model else _counter(data, name, special).counts(texts)
        yield batch_of(schema, **{key: piece.column(key), "n_bytes": np.diff(column_bytes(piece.column("text"))[1]), "n_tokens": counts})


_CHUNKS = pa.schema([("digest", pa.string()), ("k", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])
_SEAMS = pa.schema([
    ("digest", pa.string()), ("k", pa.int64()), ("last", pa.bool_()), ("n", pa.int64()),
    *((name, pa.list_(pa.int64())) for name in ("head", "head_n", "tail", "tail_n")),
])


def _cut(batches, chunk: int, overlap: int):
    for piece in pieces(batches):
        for digest, text in zip(piece.column("digest").to_pylist(), _texts(piece.column("text")), strict=True):
            n = max(1, -(-(len(text) - overlap) // chunk))
            for k in range(n):
                part = [digest], [k], [k == n - 1], [text[k * chunk : (k + 1) * chunk + overlap]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(part, _CHUNKS, strict=True)], schema=_CHUNKS)


def _encode(batches, chunk: int, overlap: int, margin: int, data: bytes, name: str, special: list[str]):
    for piece in pieces(batches, keep_caches=True):
        made = {f.name: [] for f in _SEAMS}
        counter = _counter(data, name, special)
        for digest, k, last, text in zip(*(piece.column(c).to_pylist() for c in ("digest", "k", "last")), _texts(piece.column("text")), strict=True):
            at, before, n = counter.places(text)
            head, tail = at <= overlap - margin, (at >= chunk) & (at <= chunk + overlap - margin)
            row = digest, k, last, n, at[head] + k * chunk, before[head], at[tail] + k * chunk, before[tail]
            for f, value in zip(_SEAMS, row, strict=True):
                made[f.name].append(value)
        yield batch_of(_SEAMS, **made)


def _spliced(seams: DataFrame) -> DataFrame:
    """Tokens of each text from its chunks; null where some seam has no common place."""
    left = seams.where("not last").select("digest", (F.col("k") + 1).alias("k"), "tail", "tail_n")
    right = seams.select("digest", "k", "head", "head_n")
    place = F.get(F.array_intersect("tail", "head"), F.lit(0))
    gain = F.element_at("tail_n", F.array_position("tail", place).cast("int")) - F.element_at("head_n", F.array_position("head", place).cast("int"))
    parts = left.join(right, ["digest", "k"]).select("digest", gain.alias("n"))
    parts = parts.unionByName(seams.where("last").select("digest", "n"))
    return parts.groupBy("digest").agg(F.when(F.count("n") == F.count("*"), F.sum("n")).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of ``docs``: its key, UTF-8 bytes, tokens of the whole text by the tokenizer file, and whether these are more than ``limit``.

    Counts are those of the file's library without begin, end or padding;
    special tokens inside texts are handled as it does by default.  Texts of
    more than ``chunk`` characters are cut into overlapping chunks, which go to
    tasks of their own, once for all equal texts (named by SHA-256).  Files
    that the proof above does not cover are encoded text by text.

    Null and empty texts have no bytes and tokens.  Bytes that are no UTF-8
    count as replacement characters.  Equal rows give equal rows, an empty
    table an empty one, a null key stays null; other columns are not read.
    """
    with open(path, "rb") as f:  # a vocabulary of some megabytes, which goes along with the tasks' code
        data = f.read()
    name = os.path.basename(path)
    special = proven(data, name)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`"), F.coalesce(F.col("`text`"), F.lit("")).alias("text"))

    def whole(some: DataFrame) -> DataFrame:
        return some.mapInArrow(lambda batches: _whole(batches, key, data, name, special), f"`{key}` {kind}, n_bytes long, n_tokens long")

    if special is None:
        counted = whole(rows)
    else:
        margin = max([8, *(len(s) + 4 for s in special)])
        huge = rows.where(F.length("text") > chunk)
        counts = _counts_of_huge(huge, chunk, max(overlap, 4 * margin), margin, data, name, special)
        named = huge.select(f"`{key}`", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("__digest"))
        named = named.join(counts.withColumnRenamed("digest", "__digest"), "__digest").select(f"`{key}`", "n_bytes", "n_tokens")
        counted = whole(rows.where(F.length("text") <= chunk)).unionByName(named)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _counts_of_huge(huge: DataFrame, chunk: int, overlap: int, margin: int, data: bytes, name: str, special: list[str]) -> DataFrame:
    """``digest, n_tokens`` of each distinct text."""
    texts = huge.select(F.sha2("text", 256).alias("digest"), "text")
    done = []
    while True:
        cut = texts.mapInArrow(lambda batches, c=chunk, o=overlap: _cut(batches, c, o), "digest string, k long, last boolean, text string")
        cut = cut.groupBy("digest", "k").agg(F.first("last").alias("last"), F.first("text").alias("text"))  # equal texts once, partly before the shuffle
        seams = cut.mapInArrow(
            lambda batches, c=chunk, o=overlap: _encode(batches, c, o, margin, data, name, special),
            "digest string, k long, last boolean, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>",
        )
        seams = stored(seams)
        counts = stored(_spliced(seams))
        forget(seams)
        done.append(counts.where("n_tokens is not null"))
        failed = counts.where("n_tokens is null").select("digest")
        if failed.isEmpty():
            return reduce(DataFrame.unionByName, done)
        texts = huge.select(F.sha2("text", 256).alias("digest"), "text").join(failed, "digest", "left_semi")
        chunk, overlap = chunk * WIDER, overlap * WIDER
