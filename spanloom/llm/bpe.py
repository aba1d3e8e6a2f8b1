"""Operator 10 - BPE encoding as a bounded-lookahead streaming transducer, and decoding.

Text streams through three steps of constant memory. Pieces: the pre-tokenising pattern is
applied to a buffer, and a piece leaves it once later text can't change it. Tokens: a piece is
merged by rank; a piece that grows beyond ``LONG`` characters is not held but streamed through
the merges, and a token leaves once it is stable. Bytes back to text: an incremental UTF-8
state machine.

Stability rests on the merge list's sufficient lookahead. Compare the merges of a text with
those of any longer one: up to their last common boundary both are the same, and that boundary
moves left only by a merge (x, y) that one of them makes at it, to the start of x; the next
such merge has a later rank, and its right part has x on its left spine. The heaviest chain of
such merges, found in one pass over the merge list, bounds how far the boundary can move, so a
boundary further than that from the end is final. This needs a list in which parts are made
before they are used and each token in one way only; for others a piece is held whole.

Defined cases: null texts are empty; empty texts have no tokens, and the digest of an empty
string; very long texts stream through in chunks. Repeated rows give repeated rows, empty tables
none. Columns of any name are kept, but one named as an output (``ids``, ``decoded``) is replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK, LONG, BLOCK, CACHE = 1 << 16, 1 << 13, 1 << 14, 150_000
#: Texts that a task encodes before it hands their ids on.
ROWS = 256
#: Characters after which no later text changes a piece that ended before them.
AHEAD = 4
#: Above any rank.
NONE = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int | None:
    """Bytes of right context after which a boundary is final; None if there is no bound."""
    made = {bytes([b]) for b in range(256)}
    left_of: dict[bytes, bytes] = {}
    heaviest: dict[bytes, int] = {}
    bound = 0
    for x, y in merges:
        if x not in made or y not in made or x + y in made:
            return None
        made.add(x + y)
        left_of[x + y] = x
        chain, spine = 0, y
        while spine:
            chain = max(chain, heaviest.get(spine, 0))
            spine = left_of.get(spine, b"")
        heaviest[x] = max(heaviest.get(x, 0), chain + len(x))
        bound = max(bound, heaviest[x])
    return bound


class Vocabulary:
    """Ids, ranks, bytes of tokens, special tokens and the pattern of one byte-level file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        pairs = [tuple(map(as_bytes, m.split(" ") if isinstance(m, str) else m)) for m in said["model"]["merges"]]
        self.ids = {as_bytes(k): v for k, v in said["model"]["vocab"].items() if all(c in letters for c in k)}
        self.special = {t["content"]: t["id"] for t in said.get("added_tokens", ())}
        self.bytes_of = {str(v): k for k, v in self.ids.items()} | {str(v): k.encode() for k, v in self.special.items()}
        self.rank_of = {(self.ids[a], self.ids[b]): r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = [self.ids[a + b] for a, b in pairs]
        self.singles = [self.ids[bytes([b])] for b in range(256)]
        self.sizes = {v: len(k) for k, v in self.ids.items()}
        self.ahead = lookahead(pairs)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._patterns(path)
        self.words, self.units = _Words(self), _Units(self)

    def _patterns(self, path: str) -> None:
        """Letters and numbers as the encoder that goes with the file has them: code points
        newer than its Unicode version are neither."""
        from tokenizers import Tokenizer

        cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        every = "".join(map(chr, range(sys.maxunicode + 1)))
        kinds: dict[str, list[list[int]]] = {"L": [], "N": [], "S": []}
        for kind, probe in (("L", r"\p{L}+"), ("N", r"\p{N}+"), ("S", r"\s+")):
            for c in map(ord, "".join(regex.findall(probe, every))):
                if kind != "S" and unicodedata.category(chr(c)) == "Cn" and len(cut("a" + chr(c))) + len(cut("1" + chr(c))) == 4:
                    continue
                if kinds[kind] and kinds[kind][-1][1] == c - 1:
                    kinds[kind][-1][1] = c
                else:
                    kinds[kind].append([c, c])
        ll, nn, ss = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in kinds[k]) for k in "LNS")
        self.pattern = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{ll}]+| ?[{nn}]+| ?[^{ss}{ll}{nn}]+|[{ss}]+(?![^{ss}])|[{ss}]+")
        self.runs = [re.compile(f"[{k}]+") for k in (ll, nn, f"^{ss}{ll}{nn}", ss)]

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank first, leftmost among equals."""
        ids = [self.singles[b] for b in raw]
        if len(ids) > 64:
            return self._merge_long(ids)
        get, merged = self.rank_of.get, self.merged
        ranks = [get(p, NONE) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (low := min(ranks)) < NONE:
            i = ranks.index(low)
            ids[i] = made = merged[low]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((made, ids[i + 1]), NONE)
            if i:
                ranks[i - 1] = get((ids[i - 1], made), NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, ranks = len(ids), self.rank_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        gone = -1
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = self.merged[rank], gone
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (p := (ids[a], ids[b])) in ranks:
                    heapq.heappush(heap, (ranks[p], a, p))
        return [x for x in ids if x != gone]


class _Words(dict):
    """Pieces to their ids as text; emptied when full, so memory stays constant."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> str:
        said = ",".join(map(str, self.vocabulary.merge(piece.encode("utf-8", "replace"))))
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = said
        return said


class _Units(dict):
    """The same for what stands between two single spaces, with the space before it."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, unit: str) -> str:
        said = ",".join(map(self.vocabulary.words.__getitem__, self.vocabulary.pieces(" " + unit)))
        if len(unit) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[unit] = said
        return said


#: A space before white space: pieces then don't begin at every single space.
UNEVEN = re.compile(r" \s")


class Encoder:
    """Text in chunks of any size in, comma-joined ids out."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.text, self.run, self.raw = vocabulary, "", None, bytearray()

    def feed(self, chunk: str, last: bool = False) -> list[str]:
        out: list[str] = []
        self.text += chunk
        if self.run is not None:
            out += self._grow(last)
        if self.run is None and self.text and not UNEVEN.search(self.text):
            end = len(self.text) if last else self.text.rfind(" ", 0, max(0, len(self.text) - 1))
            if end > 0:  # pieces begin at every space
                first, *units = self.text[:end].split(" ")
                out += map(self.v.words.__getitem__, self.v.pieces(first))
                out += map(self.v.units.__getitem__, units)
                self.text = self.text[end:]
        if self.run is None and self.text and (last or len(self.text) >= LONG):
            found = self.v.pieces(self.text)
            held = 0
            if not last:
                tail = found[-1]
                while found and held < AHEAD:
                    held += len(found.pop())
                if len(tail) >= LONG:
                    self.run = next(r for r in self.v.runs if r.match(tail[-1]))
            out += map(self.v.words.__getitem__, found)
            self.text = self.text[len(self.text) - held :] if held else ""
            if self.run is not None:
                out += self._grow(False, fresh=True)
        return out

    def _grow(self, last: bool, fresh: bool = False) -> list[str]:
        """Moves what belongs to the open run from the text to the merges."""
        space = self.run is self.v.runs[3]
        start = 1 if fresh and self.text[0] == " " and not space else 0  # a run's own leading space
        m = self.run.match(self.text, start)
        end = m.end() if m else start
        over = end < len(self.text) or last
        if space and not (last and end == len(self.text)):
            end = max(0, end - 1)  # the last white space may belong to the next piece
        self.raw += self.text[:end].encode("utf-8", "replace")
        self.text = self.text[end:]
        out = self._stable(over)
        if over:
            self.run = None
        return out

    def _stable(self, over: bool) -> list[str]:
        ahead = self.v.ahead
        if not over and (ahead is None or len(self.raw) < ahead + BLOCK):
            return []
        ids = self.v.merge(bytes(self.raw))
        done, size = len(ids), len(self.raw)
        if not over:
            size = done = 0
            for i in ids:
                if size + self.v.sizes[i] > len(self.raw) - ahead:
                    break
                size, done = size + self.v.sizes[i], done + 1
        del self.raw[:size]
        return [",".join(map(str, ids[:done]))] if done else []


class Decoder:
    """Ids as text in, text out; bytes of an unfinished character wait for the next token."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of, self.state = vocabulary.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[str], last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(v: Vocabulary, text: str) -> Iterator[str]:
    """Comma-joined ids of a text, part by part; special tokens are cut out first."""
    at = 0
    marks = [(m.start(), m.end()) for m in v.split.finditer(text)] if v.split else []
    for start, end in [*marks, (len(text), len(text))]:
        encoder = Encoder(v)
        for i in range(at, start, CHUNK):
            part = encoder.feed(text[i : min(i + CHUNK, start)], i + CHUNK >= start)
            if part:
                yield ",".join(part)
        if end > start:
            yield str(v.special[text[start:end]])
        at = end


def digests(v: Vocabulary, text: str) -> tuple[int, str, str]:
    """Tokens, SHA-256 of the ids and of the text decoded from them, in one pass."""
    n, ids, back, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(v)
    for part in encoded(v, text):
        ids.update((("," if n else "") + part).encode())
        each = part.split(",")
        n += len(each)
        back.update(decoder.feed(each).encode("utf-8", "replace"))
    back.update(decoder.feed([], True).encode("utf-8", "replace"))
    return n, ids.hexdigest(), back.hexdigest()


def default_path() -> str:
    """The byte-level vocabulary that is installed beside Python."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Columns ``keep`` (all but the text, if None) and ``ids``. ``path`` has to name the
    vocabulary on every executor."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    keep = [c for c in keep if c != "ids"]

    d = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("text"))  # names of any kind
    shape = T.StructType([*d.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def ids(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path or default_path())
        for p in parts:
            for at in range(0, p.num_rows, ROWS):  # a few texts and their ids at a time, whatever Spark's batches hold
                some = p.slice(at, ROWS)
                texts = some.column(some.num_columns - 1).to_pylist()
                made = [np.fromiter((int(x) for part in encoded(v, t or "") for x in part.split(",")), dtype=np.int32) for t in texts]
                ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made)))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], lists], names=shape.names)

    return d.mapInArrow(ids, shape).toDF(*keep, "ids")


def decode(df: DataFrame, *, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded``, the text of the ids; null ids are no ids."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        v = vocabulary(path or default_path())
        return pd.Series([Decoder(v).feed([str(i) for i in (() if x is None else x)], True) for x in ids])

    return df.withColumn("decoded", text(F.col(ids_col)))


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256; neither ids nor texts are kept."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def made(texts: pd.Series) -> pd.DataFrame:
        v = vocabulary(path or default_path())
        return pd.DataFrame([digests(v, t or "") for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(f"`{id_col}`"), made(F.col(f"`{text_col}`")).alias("__d")).select(F.col(f"`{id_col}`"), "__d.*")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text of ``documents``."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
