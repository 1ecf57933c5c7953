"""Byte-level BPE: encoding by a global distinct-word shuffle, decoding by the token-byte table (operator 3).

Each match of the split pattern is a word, encoded on its own.  A block of
about BLOCK_BYTES of whole texts is split into words with their positions; a
block sends each distinct word once, in hash buckets, so that a word of the
whole corpus meets in one bucket and is encoded once.  The ids go back to the
blocks that asked, and the block, which kept its positions as word numbers,
puts the texts' ids together in order.  A word as frequent as a third of all
words costs one entry a block.  Buckets grow in number with the text, so
neither a bucket nor a block outgrows a task; a text longer than a block is a
block of its own.

Decoding joins ids with the token-byte table (one row per token, the
vocabulary's size whatever the input), which every task holds.

Blocks are cut twice, once for the words and once for the positions, and carry
a digest of their words: input must be read in the same order each time (files
are; cut other lineage by ``written`` first), or the job stops.

Defined results: NULL and empty texts have no ids and decode to the empty
string; repeated rows are encoded alike, each with its own row; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm import textcols as X
from strata.llm.packing import pack, pack_words, unpack, unpack_words

BLOCK_BYTES = 4 << 20
_DECODE_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
#: Unicode White_Space, which the pattern's \s stands for.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A blank inside or at the end of longer white space: there, words can't be cut at blanks.
_ODD = f"[{_SPACE}] (?:[{_SPACE}]|$)"
#: White space beside a line break: there, the break is not a word of its own.
_BESIDE = f"[{_SPACE}]\n|\n[{_SPACE}]"
_MARKS = ".,;:!?#*$%&|<>()[]{}\"-_=+/@~^`\\"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 token, blank, rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def cut(piece: str, pattern) -> list[str]:
    """Words of a piece with at most a leading blank; the pattern itself for all but plain cases."""
    word = piece[1:] if piece[:1] == " " else piece
    if word.isalpha() or piece == " ":
        return [piece]
    core = word.rstrip(_MARKS)
    if core.isalpha():
        return [piece[:len(piece) - len(word) + len(core)], word[len(core):]]
    return pattern.findall(piece)


def blank_names(col: pa.Array, breaks: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pieces, each with the blank before it if any; piece number of each place; offsets of the texts; odd texts).

    No word crosses a cut.  Texts with longer white space (``odd``) have no
    pieces and are left to the caller.  ``breaks``: in texts whose line breaks
    have no white space beside them, a break starts a piece too.
    """
    n = len(col)
    odd = np.flatnonzero(pc.match_substring_regex(col, _ODD).to_numpy(zero_copy_only=False))
    if len(odd):
        col = pc.replace_with_mask(col, pa.array(np.isin(np.arange(n), odd)), pa.array([""] * len(odd), col.type))
    lines = pc.invert(pc.match_substring_regex(col, _BESIDE)) if breaks else pa.array(np.zeros(n, bool))
    parts = pc.split_pattern(pc.if_else(lines, pc.replace_substring(col, "\n", " \n"), col) if breaks else col, " ")
    coded = parts.flatten().dictionary_encode()
    names = coded.dictionary
    off = parts.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + 1
    key[off[:-1]] -= 1  # a text's first piece follows no blank
    if breaks:
        first = pc.starts_with(names, "\n").to_numpy(zero_copy_only=False)
        key[first[key >> 1] & np.repeat(lines.to_numpy(zero_copy_only=False), np.diff(off))] &= -2
    held = np.bincount(key, minlength=2 * len(names)) > 0
    at = np.flatnonzero(held)
    blank = pc.if_else(pa.array((at & 1).astype(bool)), pa.scalar(" ", names.type), pa.scalar("", names.type))
    names = pc.binary_join_element_wise(blank, names.take(pa.array(at >> 1)), pa.scalar("", names.type))
    return names, (np.cumsum(held) - 1)[key], off, odd


def blank_pieces(col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The same with the pieces as Python strings."""
    names, *places = blank_names(col)
    return names.to_pylist(), *places


def block_words(col: pa.Array, pattern) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words by falling frequency, word number of each position, positions of each text)."""
    col = col.fill_null("") if col.null_count else col
    pieces, key, off, odd = blank_pieces(col)
    numbers: dict[str, int] = {}
    flat: list[int] = []
    size = np.zeros(len(pieces), np.int64)
    at = np.zeros_like(size)
    for k, piece in enumerate(pieces):
        ws = cut(piece, pattern)
        at[k], size[k] = len(flat), len(ws)
        flat += [numbers.setdefault(w, len(numbers)) for w in ws]
    seq = np.asarray(flat, np.int64)[X.ragged(at[key], size[key])]
    total = np.concatenate(([0], np.cumsum(size[key])))
    counts = total[off[1:]] - total[off[:-1]]
    if len(odd):
        chunks, ends = [], np.cumsum(counts)
        last = 0
        for i in odd.tolist():
            here = [numbers.setdefault(w, len(numbers)) for w in pattern.findall(col[i].as_py())]
            chunks += [seq[last:ends[i]], np.asarray(here, np.int64)]
            last, counts[i] = ends[i], len(here)
        seq = np.concatenate([*chunks, seq[last:]])
    order = np.argsort(-np.bincount(seq, minlength=len(numbers)), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    names = list(numbers)
    return [names[i] for i in order.tolist()], rank[seq] if len(seq) else seq, counts


def _blocks(batches, text, pattern, buckets):
    """(block, batch, words, positions' word numbers, counts, buckets of the words, digest) of a partition."""
    part = TaskContext.get().partitionId()
    pattern = regex.compile(pattern)
    for i, b in enumerate(X.batches_of(batches, text, BLOCK_BYTES)):
        words, seq, counts = block_words(b.column(text), pattern)
        where = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
        digest = xxhash.xxh3_64_hexdigest("\n".join(words))
        yield (part << 32) | i, b, words, seq, counts, where, digest


_ENCODERS: dict = {}


class TiktokenWords:
    """Encodes words by a rank table, as the tiktoken library does."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.name = f"tiktoken-{len(ranks)}-{xxhash.xxh3_64_hexdigest(repr(sorted(ranks.items())[:: 97]) + pattern)}"

    def __call__(self, words: list[str]) -> list[list[int]]:
        import tiktoken

        if self.name not in _ENCODERS:
            _ENCODERS[self.name] = tiktoken.Encoding(self.name, pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        enc = _ENCODERS[self.name]
        return [enc.encode_ordinary(w) for w in words]


def encode_packed(docs: DataFrame, encoder, pattern: str, key: str = "doc_id", text: str = "text", also: dict | None = None) -> DataFrame:
    """(doc_id, ids as little-endian unsigned 32-bit integers), one row per row of ``docs``.

    ``also``: further columns made from the ids where they are put together,
    name -> (Spark type, function of the Arrow column of ids).
    """
    more = also or {}
    df = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, size // BUCKET_BYTES)

    def send_words(batches):
        for block, _, words, _, _, where, digest in _blocks(batches, "text", pattern, buckets):
            order = np.argsort(where, kind="stable")
            named, first = np.unique(where[order], return_index=True)
            edges = np.append(first, len(order))
            blobs = [pack_words([words[j] for j in order[a:z].tolist()]) for a, z in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(named, pa.int64()), pa.array([block] * len(named), pa.int64()), pa.array([digest] * len(named), pa.string()),
                 pa.array(blobs, pa.binary())], ["bucket", "block", "digest", "words"])

    def encode_bucket(t: pa.Table) -> pa.Table:
        X.give_back()
        lists = [unpack_words(x) for x in t["words"].to_pylist()]
        coded = pa.chunked_array(lists, pa.string()).combine_chunks().dictionary_encode()
        ids = encoder(coded.dictionary.to_pylist())  # every word of the bucket once
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.int64, int(size.sum()))
        start = np.cumsum(size) - size
        codes, at, out = coded.indices.to_numpy(zero_copy_only=False), 0, []
        for words in lists:
            c = codes[at:at + len(words)]
            at += len(words)
            out.append((pack(size[c]), pack(flat[X.ragged(start[c], size[c])])))
        return pa.table({"block": t["block"], "bucket": t["bucket"], "digest": t["digest"],
                         "sizes": pa.array([a for a, _ in out], pa.binary()), "ids": pa.array([b for _, b in out], pa.binary())})

    def send_positions(batches):
        for block, b, words, seq, counts, where, digest in _blocks(batches, "text", pattern, buckets):
            place = np.empty(len(words), np.int64)
            place[np.argsort(where, kind="stable")] = np.arange(len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([digest], pa.string()),
                 pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("doc_id")),
                 pa.array([pack(counts)], pa.binary()), pa.array([pack(seq)], pa.binary()), pa.array([pack(place)], pa.binary())],
                ["block", "digest", "keys", "counts", "seq", "place"])

    key_type = df.schema["doc_id"].dataType
    arrow_key = pa.int64() if isinstance(key_type, T.LongType) else None

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        X.give_back()
        if len(left) != 1 or any(d != left["digest"][0].as_py() for d in right["digest"].to_pylist()):
            raise ValueError("blocks were cut in another order the second time: write the input to files first")
        order = np.argsort(right["bucket"].to_numpy())
        blobs = [(right["sizes"][int(i)].as_py(), right["ids"][int(i)].as_py()) for i in order]
        size = np.concatenate([unpack(a) for a, _ in blobs] or [np.zeros(0, np.uint64)]).astype(np.int64)
        ids = np.concatenate([unpack(b) for _, b in blobs] or [np.zeros(0, np.uint64)]).astype("<u4")
        row = left.slice(0, 1).to_pylist()[0]
        place, seq, counts = (unpack(row[c]).astype(np.int64) for c in ("place", "seq", "counts"))
        if len(place) != len(size):
            raise ValueError("a block's words did not all come back")
        start = np.cumsum(size) - size
        at, n = start[place][seq], size[place][seq]
        ends = np.cumsum(counts)
        total = np.concatenate(([0], np.cumsum(n)))
        bounds = total[np.concatenate(([0], ends))] * 4
        flat = ids[X.ragged(at, n)].tobytes()
        blobs = [flat[a:z] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        col = pa.array(blobs, pa.binary())
        return pa.table({"doc_id": pa.array(row["keys"], arrow_key) if arrow_key else left["keys"].combine_chunks().flatten(),
                         "ids": col, **{name: f(col) for name, (_, f) in more.items()}})

    words = df.mapInArrow(X.lean(send_words), "bucket long, block long, digest string, words binary")
    back = words.groupBy("bucket").applyInArrow(encode_bucket, "block long, bucket long, digest string, sizes binary, ids binary")
    blocks = df.mapInArrow(X.lean(send_positions), T.StructType([
        T.StructField("block", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("keys", T.ArrayType(key_type)),
        *(T.StructField(c, T.BinaryType()) for c in ("counts", "seq", "place"))]))
    schema = T.StructType([T.StructField("doc_id", key_type), T.StructField("ids", T.BinaryType()),
                           *(T.StructField(name, kind) for name, (kind, _) in more.items())])
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(assemble, schema)


def decoder(ranks: dict[bytes, int]):
    """Function of an Arrow column of packed ids that gives their bytes: a join with the token-byte table."""
    size = max(ranks.values(), default=-1) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    joined = b"".join(tokens)
    lens = np.fromiter(map(len, tokens), np.int64, size)

    def decode(col: pa.Array) -> pa.Array:
        table, starts = np.frombuffer(joined, np.uint8), np.cumsum(lens) - lens
        out = []
        for b in X.batches_of([pa.RecordBatch.from_arrays([col.fill_null(b"")], ["ids"])], "ids", _DECODE_BYTES):
            raw, off = X.text_buffer(b.column("ids"))
            x = np.frombuffer(raw.tobytes(), "<u4")
            n = lens[x]
            data = table[X.ragged(starts[x], n)].tobytes()
            bounds = np.concatenate(([0], np.cumsum(n)))[off // 4].tolist()
            out += [data[a:z] for a, z in zip(bounds[:-1], bounds[1:])]
        return pa.array(out, pa.binary())

    return decode


def integers(col: pa.Array) -> pa.Array:
    """Packed ids as lists of integers."""
    raw, off = X.text_buffer(col.fill_null(b""))
    return pa.ListArray.from_arrays(pa.array(off // 4, pa.int32()), pa.array(np.frombuffer(raw.tobytes(), "<i4"), pa.int32()))


def packed(col: pa.Array) -> pa.Array:
    """Little-endian ids as ``packing.pack`` writes them: about a third of their bytes on the way through shuffles."""
    return pa.array([pack(np.frombuffer(x, "<u4")) for x in col.to_pylist()], pa.binary())


def unpacked(col: pa.Array) -> pa.Array:
    """Ids from ``packed`` as lists of integers."""
    ids = [unpack(x).astype("<i4") for x in col.to_pylist()]
    off = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, "<i4"), *ids])))


def decode_packed(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its packed ``ids``: a join with the token-byte table held by every task."""
    decode = decoder(ranks)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, decode(b.column(ids).cast(pa.binary()))], [*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def digests(df: DataFrame) -> DataFrame:
    """n_tokens and the SHA-256 of packed ids and of decoded bytes."""
    return df.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                     F.sha2("decoded", 256).alias("decoded_sha256"))
