"""Bigram language model in Elias-Fano tries (operator 7).

Training documents are those whose crc32 of the doc_id's text is not 0 mod
10.  With c(w) and N, V as counts, tokens and distinct tokens of training,

    p1(w)      = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p(w | u)   = c(u w) / (c(u) + MU) + MU / (c(u) + MU) * p1(w)

(Dirichlet-prior smoothing: sums to one over all words and one unknown).  The
first part is the smoothed probability that the trie stores, quantised to 8
bits on a logarithmic scale over eight decades (a factor of 1.04 at most).

Spark's part: a block of whole texts sends its distinct bigrams, with their
training counts, to shards by context.  A shard adds up the counts, builds
its trie (contexts, pointers, successors as Elias-Fano levels), maps it into
memory, looks up every block's bigrams by successor search relative to their
context, and answers codes and context counts.  The block, which kept its
texts as bigram numbers, adds up each text.  Contexts with over 1/HOT_SHARE of
all words (so at most HOT_SHARE of them) are known beforehand with their exact
counts, and their successors are dealt over all shards.  Shards grow in number
with the text; nothing of the model's size is broadcast or collected.  ``train``
returns the shards' tries.

As for operator 3, blocks are cut twice and carry a digest: input must be read
in the same order both times.  Words are 64-bit fingerprints, successors
within a context 40 bits of them (which two words of one context share by
chance about once in 10^12 pairs).

Defined results: NULL and empty texts have one token, the end; a NULL doc_id
counts as the empty text (crc32 0), so it is held out; repeated rows all
count; an empty table gives no rows; extra columns are ignored; without
training documents only the unknown word has probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import textcols as X
from strata.llm.eliasfano import Trie
from strata.llm.packing import pack, unpack
from strata.llm.shared import written

MU = 50.0
HOT_SHARE = 1000
BLOCK_BYTES = 6 << 20
SHARD_BYTES = 8 << 20
#: Fingerprints of the tokens that are not words.
BEGIN, END = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
_SUCC = np.uint64(24)  # a successor is the upper 40 bits of its fingerprint
_DECADES = 8.0


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes 1..255 of probabilities in (0, 1]."""
    return np.clip(np.rint(255 + np.log10(p) * (254 / _DECADES)), 1, 255).astype(np.uint8)


def dequantised() -> np.ndarray:
    """Probability of each code; code 0 is none."""
    p = 10.0 ** ((np.arange(256) - 255) * (_DECADES / 254))
    p[0] = 0.0
    return p


def _tokens(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, tokens, tokens per row): BEGIN or a word, then a word or END."""
    buf, off = X.text_buffer(b.column("text"))
    buf = X.lower_ascii(buf)
    start, end, row = X.words(buf, off)
    fp = X.fingerprints(buf, start, end)
    n = np.bincount(row, minlength=b.num_rows) + 1
    last = np.cumsum(n) - 1
    token = np.full(int(n.sum()), END, np.uint64)
    mask = np.ones(len(token), dtype=bool)
    mask[last] = False
    token[mask] = fp
    ctx = np.empty_like(token)
    ctx[1:] = token[:-1]
    ctx[last - n + 1] = BEGIN
    return ctx, token, n


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col(key).cast("long").alias("doc_id"), (crc % 10 == 0).alias("held_out"), F.col(text).alias("text"))


def hot_words(df: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(fingerprints of the hot contexts, their training counts, training documents, training words).

    A word with over 1/HOT_SHARE of all training words has that share in some
    block, so the blocks' own frequent words hold all hot ones.
    """
    def frequent(batches):
        for b in X.batches_of(batches, "text", BLOCK_BYTES):
            fp, c, _, words = _train_counts(b)
            some = c * HOT_SHARE >= words
            yield pa.RecordBatch.from_arrays([pa.array(fp[some].view(np.int64)), pa.array(c[some])], ["fp", "n"])

    def exact(batches):
        for b in X.batches_of(batches, "text", BLOCK_BYTES):
            fp, c, documents, words = _train_counts(b)
            some = np.isin(fp, likely)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(fp[some].view(np.int64), [0, 1])), pa.array(np.append(c[some], [documents, words])),
                                              pa.array(np.append(np.ones(some.sum(), bool), [False, False]))], ["fp", "n", "word"])

    # of all blocks' candidates, those that can be hot: at most 2 * HOT_SHARE have half the share
    found = df.mapInArrow(frequent, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "fp").limit(2 * HOT_SHARE).collect()
    likely = np.array([r["fp"] for r in top], np.int64).view(np.uint64)
    rows = df.mapInArrow(exact, "fp long, n long, word boolean").groupBy("word", "fp").agg(F.sum("n").alias("n")).collect()
    total = {r["fp"]: r["n"] for r in rows if not r["word"]}
    documents, words = total.get(0, 0), total.get(1, 0)
    hot = sorted((r["fp"] & (1 << 64) - 1, r["n"]) for r in rows if r["word"] and r["n"] * HOT_SHARE >= words)
    if documents * HOT_SHARE >= words and documents:
        hot = sorted([*hot, (int(BEGIN), documents)])
    return np.array([a for a, _ in hot], np.uint64), np.array([b for _, b in hot], np.int64), documents, words


def _train_counts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int, int]:
    train = ~b.column("held_out").to_numpy(zero_copy_only=False)
    ctx, _, n = _tokens(b)
    ctx = ctx[np.repeat(train, n)]
    fp, c = np.unique(ctx[ctx != BEGIN], return_counts=True)
    return fp, c, int(train.sum()), int(c.sum())


def _bigrams(b: pa.RecordBatch, hot: np.ndarray, shift: np.uint64):
    """Distinct bigrams of a block by (shard, context, successor): these, training counts, and each token's bigram number."""
    ctx, token, n = _tokens(b)
    succ = token >> _SUCC
    # a hot context's successors are dealt by a hash of both
    spread = np.isin(ctx, hot)
    shard = ctx >> shift
    shard[spread] = X.mix(ctx[spread], succ[spread]) >> shift
    order = np.lexsort((succ, ctx, shard))
    s, c, w = shard[order], ctx[order], succ[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1]) | (w[1:] != w[:-1])
    number = np.empty(len(s), np.int64)
    number[order] = np.cumsum(new) - 1
    train = np.repeat(~b.column("held_out").to_numpy(zero_copy_only=False), n)
    count = np.bincount(number[train], minlength=int(new.sum()))
    return s[new].astype(np.int64), c[new], w[new], count, number, n


_REQUEST = "shard long, block long, digest string, contexts binary, sizes binary, successors binary, counts binary"


def _requests(df: DataFrame, hot: np.ndarray, shift: np.uint64) -> DataFrame:
    def run(batches):
        part = TaskContext.get().partitionId()
        for i, b in enumerate(X.batches_of(batches, "text", BLOCK_BYTES)):
            shard, ctx, succ, count, _, _ = _bigrams(b, hot, shift)
            digest = xxhash.xxh3_64_hexdigest(ctx.tobytes() + succ.tobytes())
            edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
            out = []
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
                first = np.flatnonzero(np.concatenate(([True], ctx[a + 1:z] != ctx[a:z - 1])))
                sizes = np.diff(np.append(first, z - a))
                # successors of a context rise: differences, from zero at each context
                step = np.diff(succ[a:z], prepend=np.uint64(0))
                step[first] = succ[a:z][first]
                out.append((int(shard[a]), part << 32 | i, digest, pack(np.diff(ctx[a:z][first], prepend=np.uint64(0))), pack(sizes),
                            pack(step), pack(count[a:z])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 4))],
                                             [f.split()[0] for f in _REQUEST.split(", ")])

    return df.mapInArrow(run, _REQUEST)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, successors per context, successors, counts) of a request."""
    ctx = np.cumsum(unpack(row["contexts"]), dtype=np.uint64)
    sizes = unpack(row["sizes"]).astype(np.int64)
    total = np.cumsum(unpack(row["successors"]), dtype=np.uint64)
    first = np.cumsum(sizes) - sizes
    before = np.where(first > 0, total[np.maximum(first - 1, 0)], np.uint64(0))
    return ctx, sizes, total - np.repeat(before, sizes), unpack(row["counts"]).astype(np.int64)


def _shard(t: pa.Table, hot: np.ndarray, hot_counts: np.ndarray, mu: float):
    """(trie, contexts with their training counts, opened requests) of a shard."""
    opened = [_opened(r) for r in t.select(["contexts", "sizes", "successors", "counts"]).to_pylist()]
    ctx = np.concatenate([np.repeat(c, s) for c, s, _, _ in opened])
    succ, count = np.concatenate([x[2] for x in opened]), np.concatenate([x[3] for x in opened])
    seen = count > 0
    ctx, succ, count = ctx[seen], succ[seen], count[seen]
    order = np.lexsort((succ, ctx))
    ctx, succ, count = ctx[order], succ[order], count[order]
    pair = np.flatnonzero(np.concatenate(([True], (ctx[1:] != ctx[:-1]) | (succ[1:] != succ[:-1])))) if len(ctx) else np.zeros(0, np.int64)
    c2 = np.add.reduceat(count, pair) if len(pair) else np.zeros(0, np.int64)
    ctx, succ = ctx[pair], succ[pair]
    start = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(ctx) else np.zeros(0, np.int64)
    names = ctx[start]
    c1 = np.add.reduceat(c2, start) if len(start) else np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(hot, names), max(0, len(hot) - 1))
    if len(hot):
        c1 = np.where(hot[at] == names, hot_counts[at], c1)  # a hot context has successors elsewhere
    p = c2 / (np.repeat(c1, np.diff(np.append(start, len(ctx)))) + mu)
    return Trie.build(names, start, succ, quantise(p)), names, c1, opened


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", mu: float = MU) -> DataFrame:
    """(shard, contexts, bigrams, trie) of the model: one row per shard."""
    df = _rows(docs, key, text)
    hot, hot_counts, _, _ = hot_words(df)

    def build(t: pa.Table) -> pa.Table:
        blob, names, _, opened = _shard(t, hot, hot_counts, mu)
        return pa.table({"shard": t["shard"].slice(0, 1), "contexts": pa.array([len(names)], pa.int64()),
                         "bigrams": pa.array([Trie(blob).successors.n], pa.int64()), "trie": pa.array([blob], pa.binary())})

    return _requests(df, hot, _shift(df)).groupBy("shard").applyInArrow(build, "shard long, contexts long, bigrams long, trie binary")


def _shift(df: DataFrame) -> np.uint64:
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return np.uint64(64 - max(3, int(size // SHARD_BYTES).bit_length()))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", mu: float = MU) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    df = _rows(docs, key, text)
    hot, hot_counts, documents, n_words = hot_words(df)
    shift = _shift(df)

    def answer(t: pa.Table) -> pa.Table:
        blob, names, c1, opened = _shard(t, hot, hot_counts, mu)
        trie = Trie.mapped(blob)
        counts, codes = [], []
        for ctx, sizes, succ, _ in opened:
            # every known context: also hot ones that are followed by nothing in this shard
            own = np.zeros(len(ctx), np.int64)
            for keys, values in ((names, c1), (hot, hot_counts)):
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, ctx), len(keys) - 1)
                    own = np.where(keys[at] == ctx, values[at], own)
            counts.append(pack(own))
            codes.append(pack(trie.lookup(np.repeat(ctx, sizes), succ)))
        cold = int((~np.isin(names, hot) & (names != BEGIN)).sum())
        return pa.table({"block": t["block"], "digest": t["digest"], "shard": t["shard"], "sizes": t["sizes"],
                         "counts": pa.array(counts, pa.binary()), "codes": pa.array(codes, pa.binary()),
                         "words": pa.array([cold] + [0] * (len(t) - 1), pa.int64())})

    answers = written(_requests(df, hot, shift).groupBy("shard").applyInArrow(
        answer, "block long, digest string, shard long, sizes binary, counts binary, codes binary, words long"), "answers")
    distinct = (answers.agg(F.sum("words")).first()[0] or 0) + int((hot != BEGIN).sum()) + (documents > 0)
    total = n_words + documents
    scale = total + 0.1 * (distinct + 1)
    values = dequantised()

    def positions(batches):
        part = TaskContext.get().partitionId()
        for i, b in enumerate(X.batches_of(batches, "text", BLOCK_BYTES)):
            _, ctx, succ, _, number, n = _bigrams(b, hot, shift)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | i], pa.int64()), pa.array([xxhash.xxh3_64_hexdigest(ctx.tobytes() + succ.tobytes())], pa.string()),
                 pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("doc_id")),
                 pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("held_out")),
                 pa.array([pack(number)], pa.binary()), pa.array([pack(n)], pa.binary())], ["block", "digest", "ids", "held", "number", "n"])

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        if len(left) != 1 or any(d != left["digest"][0].as_py() for d in right["digest"].to_pylist()):
            raise ValueError("blocks were cut in another order the second time: write the input to files first")
        order = np.argsort(right["shard"].to_numpy()).tolist()
        code, count = [], []
        for i in order:
            sizes = unpack(right["sizes"][i].as_py()).astype(np.int64)
            code.append(unpack(right["codes"][i].as_py()).astype(np.int64))
            count.append(np.repeat(unpack(right["counts"][i].as_py()).astype(np.int64), sizes))
        row = left.to_pylist()[0]
        number, n = unpack(row["number"]).astype(np.int64), unpack(row["n"]).astype(np.int64)
        code, c1 = np.concatenate(code)[number], np.concatenate(count)[number]
        last = np.cumsum(n) - 1
        own = np.empty(len(number), np.int64)  # the token's count: that of the next context, which it is
        own[:-1] = c1[1:]
        own[last] = documents
        p1 = (own + 0.1) / scale
        p = np.where(c1 > 0, values[code] + mu / (c1 + mu) * p1, p1)
        start = last - n + 1
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(n),
                         "n_known": pa.array(np.add.reduceat((own > 0).astype(np.int64), start)), "train_tokens": pa.array(np.full(len(n), total, np.int64)),
                         "base_score": pa.array(np.add.reduceat(np.log10(p1), start)), "score": pa.array(np.add.reduceat(np.log10(p), start))})

    blocks = df.mapInArrow(positions, "block long, digest string, ids array<long>, held array<boolean>, number binary, n binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
