"""Secret scans: fixed patterns plus a randomness test battery (operator 9).

Base spans follow three fixed patterns.  Every other long run of token
characters is tested for randomness: its encoding (the smallest alphabet that
holds it) is inferred, then chi-squared uniformity over that alphabet, a runs
test around the alphabet's middle and a lag-1 serial correlation give p-values
of "uniformly random", combined by Fisher's method.  Runs of letters alone or
digits alone are never credentials here.  A candidate's p-value (letters and
digits) is the chance that a word-like run of its alphabet and length looks at
least as random.  That null is computed, never taken from the corpus: words of
letters by their frequency in prose, cased, joined and numbered as identifiers
are, drawn with a fixed seed; below the most random draws a gamma tail goes
on, so the p-value has no floor.  A run is cut at inner '=', and what no
alphabet holds is read in three ways: cut at ``-_``, at ``+/`` and at all four;
the parts of the reading with the smallest p-value are the candidates.  What
an alphabet holds is one candidate, by the smaller p-value of the whole and of
its parts between marks.  A p-value picked from several is multiplied by their
number.  Benjamini and Hochberg's rule over all
candidates of the corpus then picks the discoveries at rate ``q``.  Counts
over all documents; only one row per p-value bin reaches the driver.

Defined results: NULL or empty text has no spans (hash of the empty string);
repeated rows are scanned alike; an empty table gives no rows; extra columns
are ignored (``scan``) or kept (``redact``).  Offsets are code points, end
exclusive.  A span found by the battery never overlaps a base span.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm import textcols as X
from strata.llm.shared import fresh, written

# Fixed patterns (required for equal results).
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ["assign", "access", "hex", "random"]
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_HEX, MIN_ACCESS, MIN_VALUE = 32, 16, 8

#: Shortest run the battery tests; bins of the p-value, BIN_STEPS to a power of ten.
MIN_RUN = 20
BINS, BIN_STEPS = 400, 10
#: Lengths of the nulls (a run takes the next one below), word-like runs drawn for each, draws that fix the tail.
NULL_LENGTHS = [20, 22, 24, 26, 28, 32, 36, 40, 48, 56, 64, 80, 96, 128, 192, 256]
NULL_RUNS, NULL_TAIL = 2_000, 20
#: Scripts whose letters stand in one word with Latin ones, and accents; not kana, ideographs, Hangul or Thai, which touch Latin words without a blank.
_JOINING = ("LATIN ", "GREEK ", "CYRILLIC ", "COMBINING ")
#: Letters per thousand letters of prose.
_PROSE = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 2, 2, 1, 1)))
_BATCH = 4 << 20


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[ord(c) for c in chars]] = True
    return t


_DIGIT, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX = _class("0123456789abcdef")
_TOKEN = _class(_DIGIT + _LOW + _UP + "+/_=-")
#: Alphabets from the smallest to the largest; a run's encoding is the first that holds it.
ENCODINGS = [("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("letters", _LOW), ("LETTERS", _UP),
             ("base32", _UP + "234567"), ("base36", _DIGIT + _LOW), ("BASE36", _DIGIT + _UP), ("mixed", _UP + _LOW),
             ("base62", _DIGIT + _UP + _LOW), ("base64", _UP + _LOW + _DIGIT + "+/"), ("base64url", _UP + _LOW + _DIGIT + "-_")]
_CODES = []
for _name, _chars in ENCODINGS:
    _t = np.full(256, -1, dtype=np.int64)
    _t[[ord(c) for c in _chars]] = np.arange(len(_chars))
    _CODES.append((_name, len(_chars), _t))
_BY_NAME = {_name: (_k, _t) for _name, _k, _t in _CODES}


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run: bytes) -> tuple[str, float, float, float] | None:
    """(encoding, p of uniformity, p of the runs test, p of serial correlation), or None if no alphabet holds it."""
    raw = np.frombuffer(run.rstrip(b"="), np.uint8)
    for name, _, table in _CODES:
        if len(raw) >= 8 and (table[raw] >= 0).all():
            return name, *tested_as(run, name)
    return None


def tested_as(run: bytes, name: str) -> tuple[float, float, float]:
    """p of uniformity, of the runs test and of serial correlation of a run that alphabet ``name`` holds."""
    raw = np.frombuffer(run.rstrip(b"="), np.uint8)
    n = len(raw)
    k, table = _BY_NAME[name]
    x = table[raw]
    counts = np.bincount(x, minlength=k)
    chi = float((counts.astype(float) ** 2).sum()) * k / n - n
    # chi-squared with the multinomial's own variance, by Wilson and Hilferty's cube root
    dof = (k - 1) * n / (n - 1)
    scaled = chi * n / (n - 1)
    p_chi = _normal_tail(((scaled / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof)))
    above = x * 2 >= k
    a = int(above.sum())
    b = n - a
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((above[1:] != above[:-1]).sum())
        p_runs = min(1.0, 2 * _normal_tail(abs(runs - mean) / math.sqrt(var))) if var > 0 else 0.0
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    s = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / s if s > 0 else 1.0
    p_serial = min(1.0, 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n)))
    return p_chi, p_runs, p_serial


def fisher(ps) -> float:
    """Fisher's statistic over p-values: the smaller, the more random the run looks."""
    return -sum(math.log(max(p, 1e-300)) for p in ps)


def _word_like(chars: str, n: int, rng: np.random.Generator) -> list[bytes]:
    """NULL_RUNS word-like runs of ``n`` characters of an alphabet, each with a digit."""
    low, up = [c for c in _LOW if c in chars], [c for c in _LOW if c.upper() in chars]
    letters = low or up
    share = np.array([_PROSE[c] for c in letters], float)
    digits, marks = [c for c in _DIGIT if c in chars], [c for c in "-_/+" if c in chars]
    out: list[str] = []
    while sum(map(len, out)) < NULL_RUNS * n:
        words = 1 + NULL_RUNS * n // 5
        text = "".join(rng.choice(letters, 9 * words, p=share / share.sum()).tolist())
        size, style = rng.integers(2, 10, words).tolist(), rng.random(words).tolist()
        numbered, joined = rng.random(words).tolist(), rng.random(words).tolist()
        number = rng.integers(0, len(digits), (words, 4))
        tail = rng.integers(1, 5, words).tolist()
        for k in range(words):
            w = text[9 * k:9 * k + size[k]]
            if not low or (up and style[k] < 0.1):
                w = w.upper()
            elif up and style[k] < 0.5:
                w = w.capitalize()
            if numbered[k] < 0.25:
                w += "".join([digits[d] for d in number[k, :tail[k]].tolist()])
            if marks and joined[k] < 0.5:
                w += marks[k // 16 % len(marks)]  # names keep to one mark
            out.append(w)
    stream = "".join(out)
    runs = [stream[n * k:n * k + n] for k in range(NULL_RUNS)]
    last = rng.integers(0, len(digits), NULL_RUNS).tolist()
    return [(r if any(d in r for d in digits) else r[:-1] + digits[d]).encode() for r, d in zip(runs, last)]


def _log_gamma_cdf(a: float, x: float) -> float:
    """Log of the regularized lower incomplete gamma function, by its series."""
    if x <= 0:
        return -math.inf
    total = term = 1.0
    k = a
    while term > total * 1e-12:
        k += 1
        term *= x / k
        total += term
    return a * math.log(x) - x - math.lgamma(a + 1) + math.log(total)


@functools.lru_cache(maxsize=None)
def _null(name: str, n: int) -> tuple[np.ndarray, float, float, float]:
    """(sorted statistics of word-like runs, gamma shape, gamma scale, its log cdf where the tail begins)."""
    rng = np.random.default_rng([n, *name.encode()])
    chars = dict(ENCODINGS)[name]
    h = np.sort([fisher(tested_as(r, name)) for r in _word_like(chars, n, rng)])
    scale = float(h.var() / h.mean())
    shape = float(h.mean() / scale)
    return h, shape, scale, _log_gamma_cdf(shape, float(h[NULL_TAIL - 1]) / scale)


def p_value(name: str, n: int, h: float) -> float:
    """Chance that a word-like run of this alphabet and length looks as random as statistic ``h`` says."""
    draws, shape, scale, start = _null(name, max(x for x in NULL_LENGTHS if x <= max(n, NULL_LENGTHS[0])))
    if h >= draws[NULL_TAIL - 1]:
        return (1 + int(np.searchsorted(draws, h, side="right"))) / (1 + len(draws))
    return (1 + NULL_TAIL) / (1 + len(draws)) * math.exp(_log_gamma_cdf(shape, h / scale) - start)


#: Parts of a run of token characters between '='; '=' at its end pads the last one.
_PART = re.compile(rb"[A-Za-z0-9+/_-]+(?:=+$)?")
_READINGS = [re.compile(rb"[A-Za-z0-9+/]+=*"), re.compile(rb"[A-Za-z0-9_-]+=*"), re.compile(rb"[A-Za-z0-9]+=*")]


def _whole_p(part: bytes) -> float | None:
    """P-value of a candidate; None for short ones, for letters or digits alone, and where no alphabet holds it."""
    if len(part) < MIN_RUN or not (re.search(rb"[0-9]", part) and re.search(rb"[A-Za-z]", part)):
        return None
    got = battery(part)
    return None if got is None else p_value(got[0], len(part.rstrip(b"=")), fisher(got[1:]))


def candidates(run: bytes) -> list[tuple[int, int, float]]:
    """(start, end, p-value) of the candidates of a run of token characters."""
    out = []
    for m in _PART.finditer(run):
        part = m.group()
        readings = [[(m.start() + x.start(), m.start() + x.end(), p) for x in cut.finditer(part)
                     if x.group() != part and (p := _whole_p(x.group())) is not None] for cut in _READINGS]
        readings = [r for k, r in enumerate(readings) if r and r not in readings[:k]]
        whole = _whole_p(part)
        if whole is not None:
            ps = [whole, *{(a, z): p for r in readings for a, z, p in r}.values()]
            out.append((m.start(), m.end(), min(1.0, min(ps) * len(ps))))
        elif readings:
            best = min(readings, key=lambda r: min(p for _, _, p in r))
            out += [(a, z, min(1.0, p * len(readings))) for a, z, p in best]
    return out


def p_bin(p: float) -> int:
    """Bin of a p-value: bin b holds those of 10 ** (-b / BIN_STEPS) at most."""
    return min(BINS - 1, int(-BIN_STEPS * math.log10(max(p, 1e-300))))


def _runs(mask: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of ``mask`` of ``least`` bytes or more; runs end with their row."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(len(mask) + 1, dtype=bool)
    change[1:-1] = mask[1:] != mask[:-1]
    change[0] = change[-1] = True
    change[off] = True
    at = np.flatnonzero(change)
    start, end = at[:-1], at[1:]
    keep = mask[start] & (end - start >= least)
    return start[keep], end[keep]


def _joins(near: bytes, at: int) -> bool:
    """Whether the code point beside a run (the last or first of ``near``) is a letter or accent that Latin words are joined with."""
    if not near or near[at] < 0x80:
        return False
    if at:
        first = max((k for k, c in enumerate(near) if c & 0xC0 != 0x80), default=0)
        char = near[first:].decode("utf-8", "replace")[-1]
    else:
        char = near.decode("utf-8", "replace")[0]
    return unicodedata.category(char)[0] in "LM" and unicodedata.name(char, "").startswith(_JOINING)


def find(buf: np.ndarray, off: np.ndarray) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """Per row: base spans (kind index, start, end), and tested runs (start, end, bin), in code points."""
    n = len(off) - 1
    raw = buf.tobytes()
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    base: list[list[tuple]] = [[] for _ in range(n)]
    taken: list[list[tuple]] = [[] for _ in range(n)]
    for i in range(n):
        a, b = int(off[i]), int(off[i + 1])
        text = raw[a:b]
        low = text.lower()
        found = []
        if any(w in low for w in _ASSIGN_WORDS):
            found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
        if b"AKIA" in text:
            found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
        for kind, s, e in found:
            taken[i].append((a + s, a + e))
            base[i].append((kind, int(points[a + s] - points[a]), int(points[a + e] - points[a])))
    start, end = _runs(_HEX[buf], off, MIN_HEX)
    rows = np.searchsorted(off, start, side="right") - 1
    for s, e, i in zip(start.tolist(), end.tolist(), rows.tolist()):
        taken[i].append((s, e))
        base[i].append((2, int(points[s] - points[off[i]]), int(points[e] - points[off[i]])))
    tested: list[list[tuple]] = [[] for _ in range(n)]
    start, end = _runs(_TOKEN[buf], off, MIN_RUN)
    rows = np.searchsorted(off, start, side="right") - 1
    for s, e, i in zip(start.tolist(), end.tolist(), rows.tolist()):
        before, after = raw[max(int(off[i]), s - 4):s], raw[e:min(int(off[i + 1]), e + 4)]
        if _joins(before, -1) or _joins(after, 0):
            continue  # part of a word with letters beyond ASCII
        z = int(points[off[i]])
        for a, b, p in candidates(raw[s:e]):
            if not any(s + a < y and x < s + b for x, y in taken[i]):
                tested[i].append((int(points[s + a]) - z, int(points[s + b]) - z, p_bin(p)))
    for x in base:
        x.sort(key=lambda t: (t[1], t[0]))
    return base, tested


_SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("bin", T.IntegerType())])
_PA_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
_PA_RUN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bin", pa.int32())]))


def _dicts(rows, keys):
    return [[dict(zip(keys, x)) for x in r] for r in rows]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base: spans of the fixed patterns, tested: runs with the bin of their p-value)."""
    df = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for b in X.batches_of(batches, "text", _BATCH):
            base, tested = find(*X.text_buffer(b.column("text")))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(_dicts(base, ("kind", "start", "end")), _PA_SPAN),
                 pa.array(_dicts(tested, ("start", "end", "bin")), _PA_RUN)], ["doc_id", "base", "tested"])

    schema = T.StructType([df.schema["doc_id"], T.StructField("base", T.ArrayType(_SPAN)), T.StructField("tested", T.ArrayType(_RUN))])
    return df.mapInArrow(run, schema)


def discoveries(hist: list[tuple[int, int]], q: float) -> int | None:
    """Benjamini-Hochberg over (bin, count): the lowest discovered bin; candidates of one bin share its largest p-value."""
    candidates = np.zeros(BINS)
    for b, n in hist:
        candidates[b] += n
    rank = np.cumsum(candidates[::-1])[::-1]
    p = 10.0 ** (-np.arange(BINS) / BIN_STEPS)
    found = np.flatnonzero((rank > 0) & (p * candidates.sum() <= q * rank))
    return int(found[0]) if len(found) else None


def threshold(scanned: DataFrame, q: float = 0.05) -> int | None:
    """Lowest discovered bin of the whole corpus; one row per bin is collected."""
    h = scanned.select(F.explode("tested").alias("t")).groupBy("t.bin").agg(F.count(F.lit(1)).alias("n"))
    return discoveries([(r["bin"], r["n"]) for r in h.collect()], q)


def _random(tested: Column, limit: int | None) -> Column:
    found = F.filter(tested, lambda t: t["bin"] >= (BINS if limit is None else limit))
    return F.transform(found, lambda t: F.struct(
        F.lit(KINDS.index("random")).cast("int").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))


def spans(docs: DataFrame, q: float = 0.05, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, found): spans of the patterns, and all spans, as arrays of (kind, start, end) by start."""
    scanned = written(scan(docs, key, text), "secrets")
    limit = threshold(scanned, q)
    every = F.concat(F.col("base"), _random(F.col("tested"), limit))
    by_start = F.transform(F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))),
                           lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.select("doc_id", "base", by_start.alias("found"))


def joined(col: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, q: float = 0.05, text: str = "text", length: str = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; ``length`` follows the text where it changes."""
    limit = threshold(scan(docs, docs.columns[0], text), q)
    flag, = fresh(docs, "redacted")

    def run(batches):
        for b in X.batches_of(batches, text, _BATCH):
            col = b.column(text)
            base, tested = find(*X.text_buffer(col))
            texts, changed = None, [False] * b.num_rows
            for i, (x, t) in enumerate(zip(base, tested)):
                cuts = sorted([(s, e) for _, s, e in x] + [(s, e) for s, e, k in t if limit is not None and k >= limit])
                if cuts:
                    texts = texts or col.to_pylist()
                    out, at = [], 0
                    for s, e in cuts:
                        if s >= at:
                            out += [texts[i][at:s], mark]
                        at = max(at, e)
                    texts[i], changed[i] = "".join([*out, texts[i][at:]]), True
            arrays = [pa.array(texts, col.type) if texts and c == text else b.column(j) for j, c in enumerate(b.schema.names)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(changed)], [*b.schema.names, flag])

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())]))
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.col(flag), F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.select(*docs.columns)
