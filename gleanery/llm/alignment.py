"""Alignment of two tokenizers' tokens over the same bytes, by pandas merge_asof.

Tokenizer A is a byte-level vocabulary, B one of sentence pieces that puts a space before the text; both therefore
read the bytes of " " + text. Per batch, two frames hold every token's document, start, end and id. An as-of merge keyed by document finds
for each start of an A token the B token that covers it, another one the A token that covers each start of a B token. The union of both
directions is all overlapping pairs. Pairs that end together are links; these ends cut both sides into groups.

Of two tokens that end together the shorter is the end of the longer, so the id pairs that can ever be linked follow from the two
vocabularies: `Vocabularies.pairs`, fewer than the bytes of all entries of both. That bounds the corpus-wide counts, which each
task adds up in an array of that size, and the table of counts that goes to every task afterwards.

Defined cases: null and empty texts, and texts that either side does not give back byte for byte (B normalizes
some characters, and U+2581 reads as a space), have no tokens: counts of 0, an empty hash. Repeated rows
and null ids are aligned each on their own; all of them count. An empty table gives an empty result. Extra columns are not
read. Long texts are merged in windows of `WINDOW` tokens; what a worker holds is one text's ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm.common import slices, stored, table
from gleanery.llm.tokens import PLAIN, vocabulary

#: A tokens merged at once, bytes of text encoded at once.
WINDOW, SLICE = 1 << 18, 1 << 20
#: Files of the byte-level vocabulary (the second holds the same entries as ranks) and of the pieces.
BYTE_LEVEL, BYTE_RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, a_path: str, ranks_path: str, b_path: str) -> None:
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(a_path)
        self.library.encode_special_tokens = True
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("byte", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, self.a_bytes = byte_letters(), [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # Every id in digits with each mark after it, as rows of bytes padded by zeros.
        self.entries = max(len(self.a_bytes), len(self.b_bytes))
        digits = np.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(self.entries)])
        self.spelled = digits.view(np.uint8).reshape(len(digits), -1)
        self.lossless = self.library.normalizer is None  # then A's bytes are the text's by construction

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """By ranks for plain texts (the same entries, a few times faster), by the library for all others."""
        plain = [PLAIN.fullmatch(t) is not None and not _long_gap(t) for t in texts]
        rest = iter(self.library.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [self.ranks.encode_ordinary(t) if p else next(rest).ids for t, p in zip(texts, plain)]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none where a side does not give the bytes back."""
        known = [i for i, t in enumerate(texts) if t]
        none = np.zeros(0, np.int64)
        left, right = [none] * len(texts), [none] * len(texts)
        spaced = [" " + texts[i] for i in known]
        for i, text, a, b in zip(known, spaced, self.encode_a(spaced), self.b.encode([texts[i] for i in known], num_threads=1)):
            raw = text.encode()
            if b"".join(map(self.b_bytes.__getitem__, b)) == raw and (self.lossless or b"".join(map(self.a_bytes.__getitem__, a)) == raw):
                left[i], right[i] = np.array(a, np.int64), np.array(b, np.int64)
        return left, right

    def pairs(self) -> np.ndarray:
        """Every (A id, B id), as A id * entries of B + B id, of which one's bytes end the other's; sorted."""
        sides = ({}, {})
        for known, entries in zip(sides, (self.a_bytes, self.b_bytes)):
            for i, raw in enumerate(entries):
                known.setdefault(raw, []).append(i)
        n = len(self.b_bytes)
        found = {a * n + b for a, raw in enumerate(self.a_bytes) for k in range(len(raw)) for b in sides[1].get(raw[k:], ())}
        found |= {a * n + b for b, raw in enumerate(self.b_bytes) for k in range(len(raw)) for a in sides[0].get(raw[k:], ())}
        return np.array(sorted(found), np.int64)


_GAP, _NEAR = re.compile(r"\s{1000}"), re.compile(r"\s\s")


def _long_gap(text: str) -> bool:
    """Whether 1000 blanks stand in line, on which a pattern that looks ahead is slow; every 500th character shows most texts free of them."""
    return _NEAR.search(text[::500]) is not None and _GAP.search(text) is not None


_LOADED: dict[tuple[str, ...], Vocabularies] = {}


def vocabularies(*paths: str) -> Vocabularies:
    """The worker's vocabularies; they hold entries only and do not grow."""
    if paths not in _LOADED:
        _LOADED[paths] = Vocabularies(*paths)
    return _LOADED[paths]


def _frame(ids: list[np.ndarray], sizes: np.ndarray) -> pd.DataFrame:
    """Tokens of all documents in order: document, start and end (bytes from the batch's start), id."""
    counts = np.array([len(x) for x in ids])
    every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(ids), dtype=np.int64), counts)
    ends = np.cumsum(sizes[every])  # documents without tokens hold no bytes here
    return pd.DataFrame({"doc": doc, "at": ends - sizes[every], "end": ends, "id": every}, copy=False)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all overlapping pairs of tokens, in order. Frames as of `_frame`, both sides covering the same bytes."""
    left, right = [], []
    for first in range(0, len(a), WINDOW):
        part = a.iloc[first : first + WINDOW]
        start = int(np.searchsorted(b["at"], part["at"].iloc[0], "right")) - 1
        other = b.iloc[start : int(np.searchsorted(b["at"], part["end"].iloc[-1], "left"))]
        mine = pd.DataFrame({"doc": part["doc"], "at": part["at"], "a": np.arange(first, first + len(part))}, copy=False)
        theirs = pd.DataFrame({"doc": other["doc"], "at": other["at"], "b": np.arange(start, start + len(other))}, copy=False)
        covered = pd.merge_asof(mine, theirs, on="at", by="doc")
        covering = pd.merge_asof(theirs, mine, on="at", by="doc").dropna()
        n = len(b)
        both = np.sort(np.concatenate([covered["a"].to_numpy() * n + covered["b"].to_numpy(), covering["a"].to_numpy(np.int64) * n + covering["b"].to_numpy()]), kind="stable")
        both = both[np.diff(both, prepend=-1) > 0]  # tokens that start together were found both ways
        left.append(both // n)
        right.append(both % n)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


class Aligned:
    """The alignment of a batch of texts."""

    def __init__(self, vocabs: Vocabularies, texts: list[str | None]) -> None:
        ids = vocabs.encode(texts)
        self.a, self.b = (_frame(side, sizes) for side, sizes in zip(ids, (vocabs.a_sizes, vocabs.b_sizes)))
        self.pair_a, self.pair_b = overlaps(self.a, self.b)
        together = self.a["end"].to_numpy()[self.pair_a] == self.b["end"].to_numpy()[self.pair_b]
        self.link_a, self.link_b = self.pair_a[together], self.pair_b[together]
        docs = np.arange(len(texts) + 1)
        self.a_from, self.b_from = (np.searchsorted(side["doc"].to_numpy(), docs) for side in (self.a, self.b))
        self.link_from = np.searchsorted(self.a["doc"].to_numpy()[self.link_a], docs)
        self.pair_from = np.searchsorted(self.a["doc"].to_numpy()[self.pair_a], docs)

    def spelled(self, vocabs: Vocabularies) -> list[bytes]:
        """Groups of each text as `a1,a2|b1;a3|b2,b3`."""
        n_a, n_b, width = len(self.a), len(self.b), vocabs.entries
        a_mark, b_mark = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        a_mark[self.link_a], b_mark[self.link_b] = 1, 2
        # Every group is its A tokens and then its B tokens; an earlier group moves all after it by its tokens of the other side.
        sizes_a, sizes_b = np.diff(self.link_a, prepend=-1), np.diff(self.link_b, prepend=-1)
        place = np.empty(n_a + n_b, np.int64)
        place[np.arange(n_a) + np.repeat(np.cumsum(sizes_b) - sizes_b, sizes_a)] = self.a["id"].to_numpy() + width * a_mark
        place[np.arange(n_b) + np.repeat(np.cumsum(sizes_a), sizes_b)] = self.b["id"].to_numpy() + width * b_mark
        letters = vocabs.spelled[place]
        held = letters != 0
        ends = np.concatenate([[0], np.cumsum(held.sum(1))])[self.a_from + self.b_from].tolist()
        text = letters[held].tobytes()
        return [text[i : j - 1] if j > i else b"" for i, j in zip(ends, ends[1:])]


def paths_of_vocabularies() -> tuple[str, str, str]:
    return vocabulary(BYTE_LEVEL), vocabulary(BYTE_RANKS), vocabulary(PIECES)


def align(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = (), paths: tuple[str, str, str] | None = None) -> DataFrame:
    """The columns in `keep`, then a_ids, b_ids, overlaps (places of tokens on both sides) and groups (first and last place of each side).

    One row per row of docs.
    """
    names = paths or paths_of_vocabularies()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("keep"), F.col(f"`{text_column}`").alias("text"))
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    schema = f"keep {rows.schema['keep'].dataType.simpleString()}, a_ids array<bigint>, b_ids array<bigint>, overlaps array<struct<a:bigint,b:bigint>>, links array<struct<a:bigint,b:bigint>>"

    def listed(values: list[np.ndarray], bounds: np.ndarray) -> pa.Array:
        flat = [pa.array(v, pa.int64()) for v in values]
        inner = flat[0] if len(flat) == 1 else pa.StructArray.from_arrays(flat, names=["a", "b"])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabs = vocabularies(*names)
        for batch in slices(batches, "text", SLICE):
            made = Aligned(vocabs, batch.column("text").to_pylist())
            base_a = made.a_from[made.a["doc"].to_numpy()]
            base_b = made.b_from[made.b["doc"].to_numpy()]
            pairs = [listed([a - base_a[a], b - base_b[b]], bounds) for a, b, bounds in ((made.pair_a, made.pair_b, made.pair_from), (made.link_a, made.link_b, made.link_from))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("keep"), listed([made.a["id"].to_numpy()], made.a_from), listed([made.b["id"].to_numpy()], made.b_from), *[p.cast(kind) for p in pairs]],
                names=["keep", "a_ids", "b_ids", "overlaps", "links"],
            )

    before = F.transform("links", lambda x, i: F.when(i > 0, F.struct((F.get("links", i - 1)["a"] + 1).alias("a"), (F.get("links", i - 1)["b"] + 1).alias("b"))).otherwise(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))))
    groups = F.zip_with(before, "links", lambda s, e: F.struct(s["a"].alias("a_first"), e["a"].alias("a_last"), s["b"].alias("b_first"), e["b"].alias("b_last")))
    made = rows.mapInArrow(run, schema).select("keep", "a_ids", "b_ids", "overlaps", groups.alias("groups"))  # kept columns may be named alike
    return made.select(*[F.col("keep")[c].alias(c) for c in keep], "a_ids", "b_ids", "overlaps", "groups")


def _digests(docs: DataFrame, id_column: str, text_column: str, names: tuple[str, str, str], pairs) -> DataFrame:  # noqa: ANN001
    """Counts, hash of the groups and linked pairs (their places in `pairs`, 32-bit) of every text."""
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabs = vocabularies(*names)
        entries = len(vocabs.b_bytes)
        for batch in slices(batches, "text", SLICE):
            made = Aligned(vocabs, batch.column("text").to_pylist())
            codes = made.a["id"].to_numpy()[made.link_a] * entries + made.b["id"].to_numpy()[made.link_b]
            raw = np.searchsorted(pairs.value, codes).astype("<u4").tobytes()
            bounds = (4 * made.link_from).tolist()
            hashes = [hashlib.sha256(s).hexdigest() if s else "" for s in made.spelled(vocabs)]
            n_links = np.diff(made.link_from)
            columns = [np.diff(made.a_from), np.diff(made.b_from), n_links]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, pa.int64()) for c in columns], pa.array(hashes, pa.string()), pa.array([raw[i:j] for i, j in zip(bounds, bounds[1:])], pa.binary())],
                names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
            )

    return rows.mapInArrow(run, "id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def _counts(digests: DataFrame, size: int) -> np.ndarray:
    """Links of every pair over the whole corpus. A task adds up `size` numbers, and so does the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slices(batches, "links", 16 << 20):
            total += np.bincount(np.frombuffer(b"".join(x.as_py() for x in batch.column("links")), "<u4"), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["pair", "n"])

    summed = digests.select("links").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size, np.int64)
    total[summed["pair"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return total


def link_digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    names = paths or paths_of_vocabularies()
    vocabs = vocabularies(*names)
    context = docs.sparkSession.sparkContext
    pairs = vocabs.pairs()
    made = stored(_digests(docs, id_column, text_column, names, context.broadcast(pairs)), "alignment")
    counts = _counts(made, len(pairs))
    of_b = pairs % len(vocabs.b_bytes)
    highest = np.zeros(len(vocabs.b_bytes), np.int64)
    np.maximum.at(highest, of_b, counts)
    known = context.broadcast((counts, (counts == highest[of_b]).astype(np.int64)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, best = known.value
        for batch in slices(batches, "links", 16 << 20):
            links = [np.frombuffer(x.as_py(), "<u4") for x in batch.column("links")]
            sums = [pa.array([int(side[x].sum()) for x in links], pa.int64()) for side in (best, total)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "n_a", "n_b", "n_groups", "groups_sha256")], *sums], names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum"])

    judged = made.mapInArrow(judge, "id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long")
    return judged.select("id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document's tokens under both vocabularies."""
    return link_digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
