"""LM scoring by deleted interpolation: n-gram estimates mixed by context-frequency bucket, weights learned by EM on held-out counts.

Counts live on servers, each with a range of 64-bit keys; documents live in chunks.  A chunk sends each server its sorted
distinct keys and their counts, and gets the corpus totals back in the same order.  What is exchanged is each distinct
key of a chunk once, packed, not a row for each token; no table of counts is ever on the driver or broadcast."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, column, documents, give_back, materialise, mix64, release_shuffles

#: Text bytes of a chunk and of a server's share, about: they bound a task's memory.  Raise both for more than terabytes.
CHUNK_BYTES, SERVER_BYTES = 4_000_000, 10_000_000
#: Documents are dealt to folds by CRC-32 of the id: HELD_OUT isn't learned from.  Of the others one in DEV, by a hash of the
#: text, is a development document: the mixture weights are learned on those, from counts that none of them has part in; so
#: copies of a development document are held out with it.
FOLDS, HELD_OUT, DEV = 5, 1, 5
#: Chunks and servers that a task takes, about: there are as many tasks as the corpus needs, at least the session's.
CHUNKS_PER_TASK = 2
#: Buckets are powers of 4 of the context's count; likelihood ratios are summed up on a grid of steps of GRID nats.  So at
#: most BUCKETS * 128 * 128 sums go to the driver, however large the corpus is.
BUCKETS, GRID, ROUNDS = 24, 0.5, 60
_END = np.uint64(0x9AE16A3B2F90404F)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Tokens(NamedTuple):
    """Tokens of a chunk's documents one after another, each with its end; word, pair and context are places in the
    sorted distinct keys of words and of pairs."""

    starts: np.ndarray
    lengths: np.ndarray
    word_keys: np.ndarray
    pair_keys: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    context: np.ndarray


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(x, return_inverse=True)
    return keys, at.astype(np.int32)


def tokens_of(texts: list[str], hashes: WordHashes) -> Tokens:
    each = [np.append(hashes(t.encode().lower().split()), _END) for t in texts]
    lengths = np.array([len(x) for x in each])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    words = np.concatenate(each)
    del each
    before = np.concatenate(([_END], words[:-1]))
    before[starts] = _END  # an end stands before every document
    # Words keep 64 bits.  Pairs have 56: of 10 ** 12 distinct pairs one in 70,000 would share a count with another.
    pair_keys, pair = _places(mix64(mix64(before * _STEP) + words) >> np.uint64(8))
    word_keys, word = _places(mix64(words))
    end = np.searchsorted(word_keys, mix64(np.array([_END])))[0]
    context = np.concatenate(([end], word[:-1]))
    context[starts] = end
    return Tokens(starts, lengths, word_keys, pair_keys, word, pair, context)


def _pack(x: np.ndarray) -> bytes:
    """64-bit numbers by byte plane: planes of zeros vanish in the exchange's compression."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


SENT = "server long, chunk long, keys binary, counts binary, tokens long"
TOTALS = "chunk long, server long, totals binary, rest binary, tokens long, vocabulary long"


def _server_of(keys: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The server of each key, 0..n-1 in the order of keys: equal shares of the range of the upper 32 bits."""
    return (keys >> np.uint64(bits - 32)) * np.uint64(n) >> np.uint64(32)


def _send(key: tuple, pdf: pd.DataFrame, servers: int) -> pd.DataFrame:
    """A row for each server that a key of the chunk falls to: pairs go to the servers 0..servers-1 by range, words to the next
    ones.  There are never more rows than keys, nor work than that, however many servers the corpus needs."""
    t = tokens_of(pdf["t"].tolist(), WordHashes())
    learned = np.repeat(pdf["fold"].to_numpy() != HELD_OUT, t.lengths)
    rows, first = [], 0
    for all_keys, at, bits, n in ((t.pair_keys, t.pair, 56, servers), (t.word_keys, t.word, 64, word_servers(servers))):
        counts = np.bincount(at[learned], minlength=len(all_keys))
        server = _server_of(all_keys, bits, n)
        cuts = [0, *(np.flatnonzero(server[1:] != server[:-1]) + 1).tolist(), len(all_keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            keys = all_keys[a:b].copy()
            keys[1:] -= all_keys[a : b - 1]
            rows.append((first + int(server[a]), key[0], _pack(keys), _pack(counts[a:b]), 0))
        first += n
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in SENT.split(", ")])
    out.loc[0, "tokens"] = int(learned.sum())
    return out


def word_servers(servers: int) -> int:
    return -(-servers // 6)


def _add_up(key: tuple, pdf: pd.DataFrame, servers: int) -> pd.DataFrame:
    """The totals of each chunk's keys; for a development chunk also the rest, to which no such chunk has added."""
    keys = [np.cumsum(_unpack(b)) for b in pdf["keys"]]
    counts = np.concatenate([_unpack(b) for b in pdf["counts"]])
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    lengths, dev = [len(k) for k in keys], pdf["chunk"].to_numpy() % 2 == 1
    totals, rest = np.zeros(len(known), np.uint64), np.zeros(len(known), np.uint64)
    np.add.at(totals, at, counts)
    learned = np.repeat(~dev, lengths)
    np.add.at(rest, at[learned], counts[learned])
    parts = np.split(at, np.cumsum(lengths)[:-1])
    out = pd.DataFrame({
        "chunk": pdf["chunk"], "server": key[0], "totals": [_pack(totals[x]) for x in parts], "rest": [_pack(rest[x]) if d else b"" for x, d in zip(parts, dev, strict=True)],
        "tokens": pdf["tokens"], "vocabulary": 0,
    })
    if key[0] >= servers:
        out.loc[out.index[0], "vocabulary"] = int((totals > 0).sum())
    return out


def _totals(pdf: pd.DataFrame, t: Tokens, which: str = "totals") -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts of the chunk's pairs and of its words, in the order of their keys."""
    got = np.concatenate([_unpack(b) for b in pdf.sort_values("server")[which]]).astype(np.float64)
    return got[: len(t.pair_keys)], got[len(t.pair_keys) :]


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the logarithm of its count to base 4."""
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)) // 2, BUCKETS - 1), 0).astype(np.int64)


def _ratio(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.divide(x, of, out=np.zeros(len(x)), where=of > 0)


EVIDENCE = "bucket long, pair long, word long, n long"


def _evidence(key: tuple, pdf: pd.DataFrame, sums: pd.DataFrame, tokens: int, vocabulary: int) -> pd.DataFrame:
    """How often each cell of (bucket, pair ratio, word ratio) to the uniform estimate occurs in a development chunk, by counts
    that no development document has part in."""
    if not len(pdf):
        return pd.DataFrame({c.split()[0]: [] for c in EVIDENCE.split(", ")}, dtype=np.int64)
    t = tokens_of(pdf["t"].tolist(), WordHashes())
    pairs, words = _totals(sums, t, "rest")
    context = words[t.context]
    pair, word = _ratio(pairs[t.pair], context), words[t.word] / max(tokens, 1)
    cell = lambda p: np.where(p > 0, np.clip(np.rint(np.log(np.maximum(p, 1e-300) * (vocabulary + 1)) / GRID) + 32, 1, 127), 0).astype(np.int64)
    cells, n = np.unique((bucket_of(context) * 128 + cell(pair)) * 128 + cell(word), return_counts=True)
    return pd.DataFrame({"bucket": cells >> 14, "pair": cells >> 7 & 127, "word": cells & 127, "n": n})


def learn_weights(evidence: pd.DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """BUCKETS x 3 weights (pair, word, uniform) by expectation-maximisation.  Every weight stays above 0, a bucket without
    evidence takes the weights of the nearest one below it, and unseen contexts give the pair no weight."""
    out = np.full((BUCKETS, 3), 1 / 3)
    for b in range(BUCKETS):
        rows = evidence[evidence["bucket"] == b]
        if not len(rows):
            out[b] = out[max(b - 1, 0)]
            continue
        p = np.stack([np.where(rows[c] > 0, np.exp((rows[c].to_numpy() - 32) * GRID), 0) for c in ("pair", "word")] + [np.ones(len(rows))], 1)
        n, w = rows["n"].to_numpy(), np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p * w
            w = ((share / share.sum(1, keepdims=True)) * n[:, None]).sum(0) + 0.5
            w /= w.sum()
        out[b] = w
    out[0, :] = [0, *(out[0, 1:] / out[0, 1:].sum())]
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(key: tuple, pdf: pd.DataFrame, sums: pd.DataFrame, tokens: int, vocabulary: int, weights: np.ndarray) -> pd.DataFrame:
    if not len(pdf):
        return pd.DataFrame({c.split()[0]: [] for c in SCORES.split(", ")})
    t = tokens_of(pdf["t"].tolist(), WordHashes())
    pairs, words = _totals(sums, t)
    c, context = words[t.word], words[t.context]
    bucket = bucket_of(context)
    p = weights[bucket, 0] * _ratio(pairs[t.pair], context) + weights[bucket, 1] * c / max(tokens, 1) + weights[bucket, 2] / (vocabulary + 1)
    base = np.log10((c + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
    add = lambda x: np.add.reduceat(x, t.starts)
    return pd.DataFrame({
        "doc_id": pdf["doc_id"].to_numpy(), "held_out": pdf["fold"].to_numpy() == HELD_OUT, "n_tokens": t.lengths, "n_known": add((c > 0).astype(np.int64)),
        "train_tokens": tokens, "base_score": add(base), "score": add(np.log10(np.maximum(p, 1e-300))),
    })


def _fold(id_col: str) -> Column:
    return (F.crc32(F.coalesce(column(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("long")


def _with_key(f, **fixed):
    def of_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(key, pdf, **fixed)
        give_back()
        return out

    return of_group


def _with_sums(f, **fixed):
    def of_group(key: tuple, pdf: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        out = f(key, pdf, sums, **fixed)
        give_back()
        return out

    return of_group


def _dealt(df: DataFrame, key: str, groups: int) -> DataFrame:
    """df dealt by key over tasks whose number follows that of the groups, not only the session's setting."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // CHUNKS_PER_TASK)), key)


def _exchange(dealt: DataFrame, servers: int) -> DataFrame:
    sent = dealt.groupBy("chunk").applyInPandas(_with_key(_send, servers=servers), SENT)
    return materialise(_dealt(sent, "server", servers).groupBy("server").applyInPandas(_with_key(_add_up, servers=servers), TOTALS))


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The scores of every row under a model of all rows outside the held-out fold.

    P(w | u) mixes count(u w) / count(u), count(w) / N and 1 / (V + 1) with weights that depend on how often u was seen.
    A null text is empty and has one token, its end; a repeated row counts and is scored as often as it stands; an empty
    table gives no rows.  The totals are written to the shared folder once; the driver gets N, V and a bounded grid of sums."""
    text = F.coalesce(column(text_col), F.lit(""))
    read = docs.select(column(id_col).cast("long").alias("doc_id"), text.alias("t"), _fold(id_col).alias("fold"))
    size = read.agg(F.coalesce(F.sum(F.octet_length("t") + 1), F.lit(1))).first()[0]
    chunks, servers = -(-size // CHUNK_BYTES), -(-size // SERVER_BYTES)
    # Development documents have chunks of their own, of odd numbers, so learning the weights reads those alone.
    dev = (F.col("fold") != HELD_OUT) & (F.pmod(F.xxhash64("t"), F.lit(DEV)) == 0)
    chunk = F.pmod(F.xxhash64("doc_id", F.xxhash64("t")), F.lit(chunks)) * 2 + dev.cast("long")
    texts = read.withColumn("chunk", chunk)
    dealt = _dealt(texts, "chunk", chunks)
    totals = _exchange(dealt, servers)
    release_shuffles(docs.sparkSession)  # what was exchanged for the totals is as large as the texts
    n = totals.agg(F.sum("tokens"), F.sum("vocabulary"), F.sum(F.when(F.col("chunk") % 2 == 0, F.col("tokens")))).first()
    tokens, vocabulary, rest = (int(x or 0) for x in n)
    some = _dealt(texts.where(dev), "chunk", chunks).groupBy("chunk").cogroup(_dealt(totals.where("chunk % 2 = 1").drop("totals"), "chunk", chunks).groupBy("chunk"))
    cells = some.applyInPandas(_with_sums(_evidence, tokens=rest, vocabulary=vocabulary), EVIDENCE)
    weights = learn_weights(cells.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).toPandas())
    both = dealt.groupBy("chunk").cogroup(_dealt(totals.drop("rest"), "chunk", chunks).groupBy("chunk"))
    return both.applyInPandas(_with_sums(_score, tokens=tokens, vocabulary=vocabulary, weights=weights), SCORES)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; a null text is empty, repeated rows are scored each."""
    return score_corpus(documents(spark, sf_dir))


QUERIES = {"op5_lm_scoring": op5_lm_scoring}
#: Expectation-maximisation isn't SQL: tests hold the counts and base scores against a plain model, and held-out likelihood.
ORACLES: dict[str, str] = {}
