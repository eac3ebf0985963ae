"""Best-fit packing of tokenised documents into fixed sequences, with certified bounds and repacking of gaps."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Pre-tokenizer pattern of the byte-level vocabulary: a fixed value of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Runs of white space this long take the file's own library: the pattern's look-ahead steps back over the whole run.
_LONG_SPACE = re.compile(r"\s{100000}")

_encoders: dict = {}


def _vocabulary(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def encoder(vocabulary: str | None = None):
    """Encoder with the ids of a byte-level BPE file (by default ``byte_bpe_50k.json`` of the public tokenizer files).

    The file's vocabulary gives the ranks; its merges are in rank order, so merging the lowest rank first yields the
    same ids as the file's own library. A text is split at the file's added tokens, which get their own ids
    (``encode(text, allowed_special="all")``).
    """
    import tiktoken

    vocabulary = _vocabulary(vocabulary)
    if vocabulary not in _encoders:
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        # printable stand-ins of bytes: the printable ones stand for themselves, the others for 256 and up, in order
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stands = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}
        added = spec.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at their surroundings are not supported")
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(stands[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
        _encoders[vocabulary] = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[vocabulary]


def token_ids(text: str, vocabulary: str | None = None) -> list[int]:
    """Ids of a whole text, those that the vocabulary file's own library gives without special tokens."""
    if len(text) >= 100_000 and _LONG_SPACE.search(text):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(_vocabulary(vocabulary)).encode(text, add_special_tokens=False).ids
    return encoder(vocabulary).encode(text, allowed_special="all")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, cap: int = 2048, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids (closed by ``end_id``): only documents over ``cap`` are cut, the first piece may be shorter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.array([*(token_ids(text, vocabulary) if text else ()), end_id], "<u4")
                first = len(ids) % cap or cap
                at = 0
                for k, stop in enumerate(range(min(first, len(ids)), len(ids) + 1, cap)):
                    part = ids[at:stop]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else ())))
                    at = stop
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


def lower_bound(sizes: np.ndarray, cap: int, counts: np.ndarray | None = None) -> int:
    """Bins that any packing of ``sizes`` (each as often as ``counts`` says) needs, by dual feasible functions.

    First family, for each threshold a: sizes over cap - a count as a whole bin, sizes under a as nothing. Second
    family, for k = 1, 2, ..: x becomes floor((k + 1) x / cap) / k, or stays where (k + 1) x / cap is whole.
    """
    if not len(sizes):
        return 0
    n = np.bincount(sizes, counts, cap + 1).astype(np.int64)[: cap + 1]
    x = np.arange(cap + 1)
    total, count = np.cumsum(n * x), np.cumsum(n)
    best = -(-int(total[-1]) // cap)
    a = np.arange(1, cap // 2 + 1)
    big = count[-1] - count[cap - a]
    middle = total[cap - a] - total[a - 1]
    best = max(best, int((big - (-middle // cap)).max()))
    for k in range(1, 101):
        scaled = (k + 1) * x
        f = np.where(scaled % cap == 0, x * k, scaled // cap * cap)  # in units of 1 / (k cap)
        best = max(best, -(-int((n * f).sum()) // (k * cap)))
    return best


def best_fit(sizes: np.ndarray, cap: int) -> np.ndarray:
    """Bin number of each size, best-fit decreasing; ``sizes`` must be sorted largest first."""
    out = np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(cap + 1)]
    mask = bins = 0  # bit r of the mask: a bin with r places is open
    for i, s in enumerate(sizes.tolist()):
        fits = mask >> s
        if s and fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b = cap, bins
            bins += 1
        out[i] = b
        if r > s:
            room[r - s].append(b)
            mask |= 1 << (r - s)
    return out


_PACKED = PIECES + ", sequence_id long, offset long, part long, bin long, open boolean, bins long, bound long"
_COLUMNS = [x.split()[0] for x in _PACKED.split(", ")]


def _pack(cap: int, level: int, root: bool, release: int):
    """One node: best-fit decreasing over its pieces; bins with room, the emptiest first, stay open for the exchange."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy(np.int64)
        bins = best_fit(sizes, cap)
        bound = lower_bound(sizes, cap)
        if level:  # a rerun that needs more bins than came in is not taken
            old = pd.factorize(pd.MultiIndex.from_frame(pdf[["came", "bin"]]))[0]
            if len(old) and old.max() < bins.max():
                bins = old
        count = int(bins.max()) + 1
        fill = np.bincount(bins, weights=sizes, minlength=count).astype(np.int64)
        order = np.argsort(fill, kind="stable")
        open_bins = np.zeros(count, bool)
        # a certified node is optimal by itself and passes on its emptiest bin alone
        if not root:
            open_bins[order[: release if count > bound else 1]] = True
            open_bins &= fill < cap
        pdf = pdf.assign(bin=bins, open=open_bins[bins], bins=count, bound=bound)
        by_bin = pdf.groupby("bin", sort=False)["length"]
        pdf["offset"] = by_bin.cumsum() - pdf["length"]
        pdf["sequence_id"] = (level << 56) + pdf["part"] * (1 << 32) + pdf["bin"]
        return pdf[_COLUMNS]

    return run


def pack(pieces: DataFrame, cap: int = 2048, per_part: int = 100_000, fan_in: int = 16, release: int = 256) -> DataFrame:
    """Sequences of at most ``cap`` ids: the columns of ``pieces`` with ``sequence_id, offset, part, bins, bound``.

    Pieces are dealt by hash over parts of about ``per_part``; each part is packed best-fit decreasing and certified
    where its bins equal its lower bound. A part with a gap gives its ``release`` emptiest bins (a certified one its
    emptiest) to an exchange: those of ``fan_in`` parts meet and are packed again, level by level up to one node. A
    level never uses more bins than it was given. Nodes are bounded: ``fan_in * release`` bins. Where a part's gap is
    wider than ``release``, what the exchange could have saved beyond those bins stays; :func:`certificate` says how far
    the whole packing is from its bound.
    """
    rows = pieces.count()
    parts = max(1, -(-rows // per_part))
    items = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    closed, level = None, 0
    while True:
        root = parts == 1
        out = cut(items.groupBy("part").applyInPandas(_pack(cap, level, root, release), _PACKED), f"packed{level}")
        done = out.filter("not open")
        closed = done if closed is None else closed.unionByName(done)
        if root:
            return closed.drop("open", "bin")
        items = out.filter("open").withColumn("came", F.col("part")).withColumn("part", F.floor(F.col("part") / fan_in))
        parts, level = -(-parts // fan_in), level + 1


def certificate(packed: DataFrame, cap: int = 2048) -> tuple[int, int]:
    """Sequences of a packing, and the bound that no packing of these pieces goes below (from the counts of sizes: one row a size)."""
    sizes = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas()
    bound = lower_bound(sizes["length"].to_numpy(np.int64), cap, sizes["n"].to_numpy(np.int64))
    return packed.select("sequence_id").distinct().count(), bound


def best_fit_packing(docs: DataFrame, cap: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null text is empty: one piece that holds the end id. Repeated rows are packed each; a null doc_id is kept. Ties in
    length are packed in order of doc_id, piece. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    packed = pack(cut(tokenised_pieces(docs, cap, vocabulary=vocabulary), "pieces", few=True), cap)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
