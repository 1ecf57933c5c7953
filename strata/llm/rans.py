"""Token ids in rANS-coded files (operator 8).

Coder: static range asymmetric numeral system with 64-bit states and 32-bit
words.  One frequency table, counted over all tokens and scaled to 2^20, is
shared by every block.  A block of BLOCK_TOKENS ids is coded by LANES
interleaved states and stands alone; every CHECK_STEPS steps it notes the
states and the word offset, so a reader may start at any checkpoint, and all
checkpoints of all blocks decode side by side.  Words and ids have CRC-32s.

File: a run of whole documents in ascending doc_id order, about FILE_TOKENS
ids (one document at least), with document ids, lengths and blocks.  Files are
rows (part, seq, ..., payload) of a Parquet table, the form in which Spark
writes to any store and a lost task leaves nothing behind; (part, seq) is
their order.

Encoding: a batch's distinct words go through the tokenizers library once
(blanks and single line breaks end words for its byte-level splitter), texts
with longer white space whole.  The id END follows each document.

Defined results: NULL and empty texts hold END only; NULL doc_ids come first;
rows of equal doc_id follow each other in the order of their ids; an empty
table gives no files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from json import loads

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm import textcols as X
from strata.llm.bpe import blank_names
from strata.llm.packing import pack, unpack
from strata.llm.shared import written

END = 0
SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 32
CHECK_STEPS = 256
BLOCK_TOKENS = 1 << 15
FILE_TOKENS = 1 << 20
MAGIC = b"SRANS1\0\0"
_BATCH = 8 << 20
#: Words a Python worker remembers; then it starts anew.
CACHE_WORDS = 800_000
LINE_WORDS = 512
_TAIL = ".,;:!?#*$%&|<>"
#: Letters with their blank, if any; letters up to U+024F are old enough for every splitter.
_LETTERS = "^ ?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"

_U32, _MASK32 = np.uint64(32), np.uint64(0xFFFFFFFF)
#: A state of at least this many times a symbol's frequency gives out a word first.
_ROOM = (LOW >> np.uint64(SCALE)) << _U32


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^SCALE, at least 1 for every symbol counted."""
    total, size = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > size:
        raise ValueError("more symbols than the scale holds")
    f = np.where(counts > 0, np.maximum(1, counts.astype(float) * size // total), 0).astype(np.int64)
    while (gap := size - int(f.sum())) != 0:  # the commonest symbols take up what rounding left
        top = np.argsort(-f, kind="stable")[:max(1, abs(gap))]
        if gap > 0:
            f[top[0]] += gap
        else:
            room = np.minimum(f[top] - 1, -(-(-gap) * f[top] // int(f[top].sum())))
            over = np.cumsum(room) - room
            f[top] -= np.clip(-gap - over, 0, room)
    return f


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    def encode(self, ids: np.ndarray) -> list[bytes]:
        """Blocks of BLOCK_TOKENS ids (the last may be short)."""
        if not len(ids):
            return []
        steps = BLOCK_TOKENS // LANES
        blocks = -(-len(ids) // BLOCK_TOKENS)
        # token i of a block: step i div LANES, lane i mod LANES.  What lacks at the end has all of the scale: it changes no state
        freq, start = np.full((2, blocks * BLOCK_TOKENS), np.uint64(1 << SCALE))
        start[:] = 0
        freq[:len(ids)], start[:len(ids)] = self.freq[ids], self.start[ids]
        freq, start = (np.ascontiguousarray(v.reshape(blocks, steps, LANES).swapaxes(0, 1)).reshape(steps, -1) for v in (freq, start))
        x = np.full(blocks * LANES, LOW, np.uint64)
        words: list[tuple[np.ndarray, np.ndarray]] = []
        checks = []
        for t in range(steps - 1, -1, -1):
            f = freq[t]
            out = np.flatnonzero(x >= f * _ROOM)
            full = x[out]
            words.append((out, full))
            x[out] = full >> _U32
            # the quotient moves up to the scale, the remainder stays: x + (x div f) (2^SCALE - f)
            x += x // f * (np.uint64(1 << SCALE) - f) + start[t]
            if t % CHECK_STEPS == 0:
                checks.append(x.reshape(blocks, LANES).copy())
        checks.reverse()
        words.reverse()
        owner = np.concatenate([o for o, _ in words]) // LANES
        data = (np.concatenate([w for _, w in words]) & _MASK32).astype("<u4")
        step = np.repeat(np.arange(steps), [len(o) for o, _ in words])
        order = np.argsort(owner, kind="stable")
        owner, data, step = owner[order], data[order], step[order]
        edge = np.searchsorted(owner, np.arange(blocks + 1))
        result = []
        for b in range(blocks):
            n = min(BLOCK_TOKENS, len(ids) - b * BLOCK_TOKENS)
            used = -(-n // LANES)
            own = data[edge[b]:edge[b + 1]].tobytes()
            marks = range(0, used, CHECK_STEPS)
            at = np.searchsorted(step[edge[b]:edge[b + 1]], np.asarray(list(marks)))  # words before a checkpoint
            states = np.stack([checks[k][b] for k in range(len(marks))])
            head = np.array([n, len(marks), len(own) // 4, zlib.crc32(own), zlib.crc32(ids[b * BLOCK_TOKENS:][:n].astype("<u4").tobytes())], "<u4")
            result.append(head.tobytes() + at.astype("<u4").tobytes() + states.astype("<u8").tobytes() + own)
        return result

    def decode(self, blocks: list[bytes]) -> np.ndarray:
        """Ids of the blocks; checkpoints of all blocks run side by side, then both checksums are compared."""
        if not blocks:
            return np.zeros(0, np.int64)
        state, at, base, length, heads, data = [], [], [], [], [], []
        offset = 0
        for raw in blocks:
            n, marks, size, crc, _ = (int(v) for v in np.frombuffer(raw, "<u4", 5))
            p = 20 + 4 * marks
            own = raw[p + 8 * marks * LANES:]
            if len(own) != 4 * size or zlib.crc32(own) != crc:
                raise ValueError("checksum of a block's words differs")
            at.append(np.frombuffer(raw, "<u4", marks, 20).astype(np.int64) + offset)
            state.append(np.frombuffer(raw, "<u8", marks * LANES, p).reshape(marks, LANES))
            span = CHECK_STEPS * LANES
            length.append(np.minimum(span, n - span * np.arange(marks)))
            data.append(np.frombuffer(own, "<u4"))
            heads.append(raw)
            base.append(n)
            offset += size
        x, at, length = np.concatenate(state).astype(np.uint64), np.concatenate(at), np.concatenate(length)
        data = np.append(np.concatenate(data), np.zeros(1, "<u4")).astype(np.uint64)
        out = np.zeros((len(x), CHECK_STEPS, LANES), np.int64)
        lane = np.arange(LANES)
        mask = np.uint64((1 << SCALE) - 1)
        for t in range(int(-(-length.max() // LANES))):
            on = t * LANES + lane[None, :] < length[:, None]
            slot = x & mask
            s = self.symbol[slot.astype(np.int64)]
            out[:, t] = s
            x = np.where(on, self.freq[s] * (x >> np.uint64(SCALE)) + slot - self.start[s], x)
            need = on & (x < LOW)
            rank = np.cumsum(need, axis=1)
            word = data[np.where(need, at[:, None] + rank - 1, len(data) - 1)]
            x = np.where(need, (x << _U32) | word, x)
            at = at + rank[:, -1]
        flat = out.reshape(len(x), -1)
        ids = flat[np.arange(flat.shape[1])[None, :] < length[:, None]]
        done = 0
        for raw, n in zip(heads, base):
            if zlib.crc32(ids[done:done + n].astype("<u4").tobytes()) != int(np.frombuffer(raw, "<u4", 1, 16)[0]):
                raise ValueError("checksum of a block's ids differs")
            done += n
        return ids


def write_file(coder: Coder, keys: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: magic, lengths of its parts, document ids and token counts, block sizes, blocks, CRC-32 of the head."""
    blocks = coder.encode(ids)
    known = np.array([0 if k is None else k for k in keys], "<i8").tobytes()
    absent = pack(np.flatnonzero([k is None for k in keys]))
    parts = [known, absent, pack(counts), pack(np.fromiter(map(len, blocks), np.int64, len(blocks)))]
    head = np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)
    return MAGIC + zlib.crc32(head).to_bytes(4, "little") + head + b"".join(blocks)


def read_file(coder: Coder, payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, token counts, ids) of a file."""
    if payload[:8] != MAGIC:
        raise ValueError("not a token file")
    sizes = np.frombuffer(payload, "<u4", 4, 12).astype(np.int64)
    edges = 28 + np.concatenate(([0], np.cumsum(sizes)))
    if zlib.crc32(payload[12:edges[-1]]) != int.from_bytes(payload[8:12], "little"):
        raise ValueError("checksum of a file's head differs")
    known, absent, counts, block = (payload[a:z] for a, z in zip(edges[:-1], edges[1:]))
    keys = np.frombuffer(known, "<i8").tolist()
    for i in unpack(absent).tolist():
        keys[i] = None
    ends = edges[-1] + np.concatenate(([0], np.cumsum(unpack(block).astype(np.int64))))
    return keys, unpack(counts).astype(np.int64), coder.decode([payload[a:z] for a, z in zip(ends[:-1], ends[1:])])


_TOKENIZERS: dict = {}


class Pieces:
    """Encodes pieces by a tokenizer of the tokenizers library, each new word once while the worker remembers it.

    A piece of letters and trailing marks is two words for the byte-level
    splitter, a line break before the letters a third; any other piece is taken
    whole.  New words of letters go to the
    library as words already split, others in lines, LINE_WORDS at a time: a
    line break is a word of its own with one id, at which the ids are cut again.
    """

    def __init__(self, json: str, added: bool = False):
        self.json, self.added = json, added
        self.name = f"{xxhash.xxh3_64_hexdigest(json)}-{added}"

    def tokenizer(self):
        """(tokenizer, ids of known words, ids of a line break, tokenizer of single words or None, which tokens begin with a blank)."""
        if self.name not in _TOKENIZERS:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import ByteLevel

            t = Tokenizer.from_str(self.json)
            t.encode_special_tokens = not self.added
            spec, single = loads(self.json), None
            splitter = spec.get("pre_tokenizer") or {}
            if (splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space", True)
                    and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
                    and all(x["special"] for x in spec.get("added_tokens") or [])):
                single = Tokenizer(t.model)   # the same model; letters with their blank are one word for its splitter
                single.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
            vocabulary = t.get_vocab()
            blank = np.zeros(1 + max(vocabulary.values(), default=0), bool)
            blank[[k for token, k in vocabulary.items() if token.startswith("\u0120")]] = True   # the byte 0x20 in byte-level tokens
            _TOKENIZERS[self.name] = (t, {}, t.encode("\n", add_special_tokens=False).ids, single, blank)
        return _TOKENIZERS[self.name]

    def marked(self, col: pa.Array) -> np.ndarray:
        """Which texts hold an added token's content and must go to the library whole."""
        out = np.zeros(len(col), dtype=bool)
        for t in self.tokenizer()[0].get_added_tokens_decoder().values() if self.added else ():
            out |= pc.match_substring(col, t.content).to_numpy(zero_copy_only=False)
        return out

    def whole(self, texts: list[str]) -> list[list[int]]:
        t = self.tokenizer()[0]
        return [e.ids for a in range(0, len(texts), 64) for e in t.encode_batch_fast(texts[a:a + 64], add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word on its own, as little-endian unsigned 32-bit integers."""
        brk = self.tokenizer()[2]
        plain = [k for k, w in enumerate(words) if len(brk) == 1 and w.removeprefix(" ").split() == [w.removeprefix(" ")]]
        out: list = [None] * len(words)
        lines = [plain[a:a + LINE_WORDS] for a in range(0, len(plain), LINE_WORDS)]
        for line, ids in zip(lines, self.whole(["\n".join([words[k] for k in line]) for line in lines])):
            ids = np.append(np.asarray(ids, "<u4"), np.uint32(brk[0]))
            ends = np.flatnonzero(ids == brk[0])
            if len(ends) == len(line):
                raw, at = ids.tobytes(), 0
                for k, end in zip(line, (4 * ends).tolist()):
                    out[k], at = raw[at:end], end + 4
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, self.whole([words[k] for k in rest])):
            out[k] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def letters(self, words: list[str]) -> list[bytes]:
        """The same for words of letters, each with a blank before it or not."""
        _, _, brk, single, blank = self.tokenizer()
        if single is None or len(brk) != 1:
            return self.words(words)
        out: list = [None] * len(words)
        # a word with its blank begins with the one token that has a blank; the others are kept apart by line breaks
        after = [k for k, w in enumerate(words) if w[:1] == " "]
        other = [k for k, w in enumerate(words) if w[:1] != " "]
        for some, apart in ((after, False), (other, True)):
            for a in range(0, len(some), 64 * LINE_WORDS):
                lines = [some[b:b + LINE_WORDS] for b in range(a, min(a + 64 * LINE_WORDS, len(some)), LINE_WORDS)]
                sent = [[w for k in line for w in ("\n", words[k])] if apart else [words[k] for k in line] for line in lines]
                for line, e in zip(lines, single.encode_batch_fast(sent, is_pretokenized=True, add_special_tokens=False)):
                    ids = np.asarray(e.ids, "<u4")
                    raw, starts = ids.tobytes(), np.flatnonzero(ids == brk[0] if apart else blank[ids])
                    for k, x, y in zip(line, (4 * (starts + apart)).tolist(), [*(4 * starts[1:]).tolist(), len(raw)]):
                        out[k] = raw[x:y]
        return out

    def coded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): the ids of piece i are the ``size[i]`` ones from ``start[i]``."""
        n = len(pieces)
        first = pc.starts_with(pieces, "\n")
        body = pc.if_else(first, pc.utf8_slice_codeunits(pieces, 1), pieces)
        core = pc.utf8_rtrim(body, characters=_TAIL)
        plain = pc.and_(pc.match_substring_regex(core, _LETTERS), pc.invert(pc.and_(first, pc.starts_with(core, " "))))
        first, plain = (x.to_numpy(zero_copy_only=False) for x in (first, plain))
        first = first & plain
        buf, off = X.text_buffer(body)
        size = pc.binary_length(core).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = plain & (size < np.diff(off))
        at = np.flatnonzero(cut)
        ends = np.concatenate(([0], np.cumsum(off[at + 1] - off[at] - size[at])))
        marks = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int32).tobytes()),
                                            pa.py_buffer(buf[X.ragged(off[at] + size[at], np.diff(ends))].tobytes()))
        words = pa.concat_arrays([pc.if_else(pa.array(plain), core, pieces), marks.cast(pieces.type), pa.array(["\n"], pieces.type)]).dictionary_encode()
        number = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        single = np.zeros(len(words.dictionary), bool)
        single[number[:n][plain]] = True
        ids = self._remembered(words.dictionary.to_pylist(), single)
        flat, long = np.frombuffer(b"".join(ids), "<u4").astype(np.int64), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        # words of every piece: a line break, the word, its marks
        count = 1 + first + cut
        place = np.cumsum(count) - count
        order = np.empty(int(count.sum()), np.int64)
        order[place[first]] = number[-1]
        order[place + first] = number[:n]
        order[(place + first)[at] + 1] = number[n:-1]
        total = np.concatenate(([0], np.cumsum(long[order])))
        start = total[place]
        return flat[X.ragged((np.cumsum(long) - long)[order], long[order])], start, np.append(start[1:], total[-1])[:n] - start

    def _remembered(self, words: list[str], single: np.ndarray) -> list[bytes]:
        known = self.tokenizer()[1]
        if len(known) > CACHE_WORDS:
            known.clear()
        ids = list(map(known.get, words))
        new = [i for i, x in enumerate(ids) if x is None]
        for encoded, some in ((self.letters, [i for i in new if single[i]]), (self.words, [i for i in new if not single[i]])):
            names = [words[i] for i in some]
            for i, w, x in zip(some, names, encoded(names)):
                ids[i] = known[w] = x
        return ids

    def __call__(self, pieces: list[str]) -> list[bytes]:
        flat, start, size = self.coded(pa.array(pieces, pa.string()))
        raw = flat.astype("<u4").tobytes()
        return [raw[4 * a:4 * (a + n)] for a, n in zip(start.tolist(), size.tolist())]


def encode(docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids: packed ids with END) of every row; a batch's first row has ``counts``, how often each token is in the batch."""
    df = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for b in X.batches_of(batches, "text", _BATCH):
            col = b.column("text").fill_null("")
            marked = pieces.marked(col)
            names, number, off, odd = blank_names(pc.if_else(pa.array(marked), pa.scalar("", col.type), col) if marked.any() else col, breaks=True)
            odd = np.union1d(odd, np.flatnonzero(marked))
            flat, start, size = pieces.coded(names)
            seq = flat[X.ragged(start[number], size[number])]
            ends = np.concatenate(([0], np.cumsum(size[number])))[off]
            seq, ends = np.insert(seq, ends[1:], END), (ends + np.arange(len(ends))).tolist()
            direct = dict(zip(odd.tolist(), pieces.whole([col[int(i)].as_py() for i in odd])))
            direct = {i: np.asarray([*x, END], np.int64) for i, x in direct.items()}
            blobs = [pack(direct[i] if i in direct else seq[a:z]) for i, (a, z) in enumerate(zip(ends[:-1], ends[1:]))]
            # an odd text's place in ``seq`` has its END already
            times = np.bincount(np.concatenate([seq, *(x[:-1] for x in direct.values())]))
            counts = pa.array([pack(times), *[None] * (len(blobs) - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(blobs, pa.binary()), counts], ["doc_id", "ids", "counts"])

    return df.mapInArrow(run, "doc_id long, ids binary, counts binary")


def frequencies(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """Scaled frequencies of all ids, added up from the batches' counts; one row per token of the vocabulary reaches the driver."""
    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column("counts").to_pylist():
                times = unpack(x).astype(np.int64)
                total[:len(times)] += times
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for r in encoded.where(F.col("counts").isNotNull()).select("counts").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r["token"]] = r["n"]
    return scaled(counts)


def write(encoded: DataFrame, freq: np.ndarray) -> DataFrame:
    """Files (part, seq, first, documents, tokens, payload) of rows (doc_id, ids), ascending in doc_id."""
    def run(batches):
        coder, part, seq = Coder(freq), TaskContext.get().partitionId(), 0
        keys, ids, n = [], [], 0

        def out():
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([keys[0]], pa.int64()), pa.array([len(keys)], pa.int64()),
                 pa.array([n], pa.int64()), pa.array([write_file(coder, keys, counts, np.concatenate(ids).astype(np.int64))], pa.binary())],
                ["part", "seq", "first", "documents", "tokens", "payload"])

        for b in batches:
            for k, blob in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                x = unpack(blob.as_py()).astype(np.uint32)
                if keys and n + len(x) > FILE_TOKENS:
                    yield out()
                    keys, ids, n, seq = [], [], 0, seq + 1
                keys.append(k)
                ids.append(x)
                n += len(x)
        if keys:
            yield out()

    ordered = encoded.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return written(ordered.mapInArrow(run, "part int, seq int, first long, documents long, tokens long, payload binary"), "token-files")


def read(files: DataFrame, freq: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian unsigned 32-bit integers) from the files; start counts all ids before."""
    parts = files.groupBy("part").agg(F.sum("tokens").alias("n"))  # one row per output partition
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    heads = files.select("part", "seq", "tokens")
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = heads.withColumn("inside", inside).join(parts, F.col("part") == F.col("p")).select(
        F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("before") + F.col("inside")).alias("start"))
    located = files.select("part", "seq", "payload").join(F.broadcast(starts) if starts.count() <= 1_000_000 else starts,
                                                          (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")))

    def run(batches):
        coder = Coder(freq)
        for b in batches:
            for start, payload in zip(b.column("start").to_pylist(), b.column("payload")):
                keys, counts, ids = read_file(coder, payload.as_py())
                raw, ends = ids.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(counts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(start + ends[:-1]), pa.array(counts),
                     pa.array([raw[4 * a:4 * z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    return located.select("start", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, json: str, vocabulary: int, key: str = "doc_id", text: str = "text",
               added: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the files, what they hold when read back).

    ``added``: an added token's content inside a text is that token, as the
    library does by default; else it is cut into ordinary pieces.
    """
    encoded = written(encode(docs, Pieces(json, added), key, text), "ids")
    freq = frequencies(encoded, vocabulary)
    files = write(encoded, freq)
    return files, read(files, freq)
