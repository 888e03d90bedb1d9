"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, frugal, quoted

LENGTH = 1024
#: Token that ends a document.
END = 0
#: Documents of a group on average; groups are packed on their own, so this bounds a task at every size of input.
GROUP = 4096
#: Public vocabulary: names of the tokenizer file and of the same vocabulary as ranks; other paths may be given.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

#: doc_key stands for a row's id and text: ids may be null or stand twice.
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, doc_key long"
PLACES = PIECES + ", sequence_id long, offset long"
#: Rows that a task remembers to tell copies of a row apart, and texts that it takes at a time.
SEEN, TEXTS = 1_000_000, 256


def _texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text, doc_id = F.coalesce(column(text_col), F.lit("")), column(id_col).cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, F.xxhash64(text)).alias("doc_key"), text.alias("t"), *more)


@lru_cache
def encoder(tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> Callable[[str], np.ndarray]:
    """Text to ids (unsigned 32-bit), as the tokenizer file gives them without special tokens added.

    The same vocabulary as ranks gives the same ids three times as fast; it is used for texts of Latin-1 characters
    without special-token strings, for which tests hold the two against each other.  All others go to the tokenizer."""
    import public_tokenizers

    path = lambda f: f if "/" in f else public_tokenizers.path(f)
    slow: list = []

    def exact(text: str) -> np.ndarray:
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(path(tokenizer)))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

    if ranks is None:
        return exact
    import base64

    import tiktoken

    with open(path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return exact(text)
        return exact(text) if "<|" in text else quick.encode_to_numpy(text, disallowed_special=())

    return ids


def _ids(encode: Callable[[str], np.ndarray], text: str) -> np.ndarray:
    return np.append(encode(text), np.uint32(END)).astype("<u4", copy=False)


def _cut(length: int, tokenizer: str, ranks: str | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [c.split()[0] for c in PIECES.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, seen, task = encoder(tokenizer, ranks), {}, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                pdf, rows = batch.iloc[at : at + TEXTS], []
                for doc_id, key, text in zip(pdf["doc_id"], pdf["doc_key"], pdf["t"], strict=True):
                    ids = _ids(encode, text)
                    if len(seen) > SEEN:
                        seen.clear()
                    again = seen[key] = seen.get(key, -1) + 1
                    copy = again and (task << 32) + again  # copies of a row are dealt on their own
                    rows += [(doc_id, s, len(p := ids[s : s + length]), zlib.crc32(p.tobytes()), len(ids), key, copy) for s in range(0, len(ids), length)]
                out = pd.DataFrame(rows, columns=[*names, "copy"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return cut


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item.  Items go by length, the longest first and ties as given, each to the first bin with room.

    A tournament tree holds at each node the largest room below it, so the first bin that fits is found in log n steps."""
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n, at = lengths[i], 1
        while at < leaves:
            at *= 2
            if room[at] < n:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= n
        while at > 1:
            at //= 2
            most = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == most:
                break
            room[at] = most
    return bins, offsets


def _pack_group(length: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def pack_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "doc_key", "copy", "start"], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), length)
        return pdf.assign(sequence_id=[(int(key[0]) << 32) + b for b in bins], offset=offsets).drop(columns=["group", "copy"])

    return pack_group


def pack(docs: DataFrame, length: int = LENGTH, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """A row for each piece: where it lies in its document and in which sequence it is laid.

    A document's ids and its end token are cut every `length` tokens; only the last piece is shorter.  Documents are
    dealt to groups by hash, about `group` to each (copies of a row each on its own), and only the pieces' numbers are shuffled.  A null text is empty: one
    piece, the end token.  Repeated rows are packed each on their own; an empty table gives no rows."""
    groups = max(1, -(-docs.count() // group))
    cut = _texts(docs, id_col, text_col).mapInPandas(frugal(_cut(length, tokenizer, ranks)), PIECES + ", copy long")
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_key", "copy"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(_pack_group(length), PLACES)


def cut_documents(docs: DataFrame, keep: list[str], length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """doc_id, doc_key, doc_tokens, crcs (of each piece in turn) and the columns to keep, of other names than these: a narrow
    row for each row of docs."""
    kept = "".join(f", {quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                pdf = batch.iloc[at : at + TEXTS]
                sizes, crcs = [], []
                for text in pdf["t"]:
                    ids = _ids(encode, text)
                    sizes.append(len(ids))
                    crcs.append([zlib.crc32(ids[s : s + length].tobytes()) for s in range(0, len(ids), length)])
                yield pdf.drop(columns="t").assign(doc_tokens=sizes, crcs=crcs)[["doc_id", "doc_key", "doc_tokens", "crcs", *keep]]

    return _texts(docs, id_col, text_col, *(column(c) for c in keep)).mapInPandas(frugal(cut), f"doc_id long, doc_key long, doc_tokens long, crcs array<long>{kept}")


def _pack_range(length: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def pack_range(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["position", "start"], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), length)
        number = {b: n for n, b in enumerate(dict.fromkeys(bins))}  # by the first piece in a sequence
        return pdf.assign(sequence_id=[(int(key[0]) << 32) + number[b] for b in bins], offset=offsets).drop(columns="group")

    return pack_range


def pack_ranges(placed: DataFrame, position: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Rows of cut_documents with a position (0, 1, ...) packed as `pack` does it, but in groups of `group` positions that
    follow each other; the position stays in the result.  Sequences are numbered by group, and inside one by the first piece that they hold: so they come in
    the order of the positions, from which none departs by more than a group."""
    start = (F.col("k") * F.lit(length)).cast("long")
    each = placed.select("doc_id", "doc_tokens", "doc_key", F.col(position).alias("position"), F.posexplode("crcs").alias("k", "ids_crc32"))
    pieces = each.select(
        "doc_id", start.alias("start"), F.least(F.lit(length), F.col("doc_tokens") - start).cast("long").alias("length"), "ids_crc32", "doc_tokens", "doc_key", "position", F.floor(F.col("position") / group).cast("long").alias("group")
    )
    return pieces.groupBy("group").applyInPandas(_pack_range(length), PLACES + ", position long")


def _lay(length: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def lay(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        ids = np.concatenate([np.frombuffer(b, "<u4") for b in pdf["ids"]])
        width = len(ids) if len(ids) & (len(ids) - 1) == 0 else length
        return pd.DataFrame({"sequence_id": [key[0]], "n_tokens": [len(ids)], "input_ids": [np.pad(ids, (0, width - len(ids))).astype(np.int32)]})

    return lay


def sequences(docs: DataFrame, places: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """The token sequences of a packing: padded to `length` with 0, or left as they are at a power of two.  Rows that are equal in
    id and text are tokenized once and laid as often as they have places; null ids are laid like others."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                pdf, rows = batch.iloc[at : at + TEXTS], []
                for key, text in zip(pdf["doc_key"], pdf["t"], strict=True):
                    ids = _ids(encode, text)
                    rows += [(key, s, ids[s : s + length].tobytes()) for s in range(0, len(ids), length)]
                yield pd.DataFrame(rows, columns=["doc_key", "start", "ids"])

    once = _texts(docs, id_col, text_col).groupBy("doc_key").agg(F.first("t").alias("t"))
    laid = places.select("doc_key", "start", "sequence_id", "offset").join(once.mapInPandas(frugal(tokens), "doc_key long, start long, ids binary"), ["doc_key", "start"])
    return laid.groupBy("sequence_id").applyInPandas(_lay(length), "sequence_id long, n_tokens long, input_ids array<int>")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies.  A null text is empty; repeated rows are packed each on their own."""
    return pack(documents(spark, sf_dir))


QUERIES = {"op6_packing": op6_packing}
#: Tokenizing isn't SQL: tests hold the packing against the tokenizer and a plain first-fit.
ORACLES: dict[str, str] = {}
