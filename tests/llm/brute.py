"""Plain-Python versions of the llm operators, for small inputs."""

import collections
import hashlib
import math
import re
import struct
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def components(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def jaccard(rows):
    """rows: (doc_id, text) -> sorted (doc_id, n_shingles, component_id)."""
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    links = [(a, b) for a in range(len(rows)) for b in range(a)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components(len(rows), links)
    low = {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [(i, len(s), low.get(r)) for r, s, (i, _) in zip(root, sets, rows)]


def quality(text):
    words = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    grams = collections.Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    hit = set()
    for k in range(len(words) - 2):
        if grams[tuple(words[k:k + 3])] > 1:
            hit |= {k, k + 1, k + 2}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), failed)


def suffix(texts, size=400):
    seen = collections.Counter()
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for k in range(len(t) - size + 1):
            seen[t[k:k + size]] += 1
    out = []
    for t in raw:
        gone, end = bytearray(len(t)), 0
        for k in range(len(t) - size + 1):
            if seen[t[k:k + size]] > 1:
                for x in range(max(k, end), k + size):
                    gone[x] = 1
                end = k + size
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def lm(rows, mu):
    """rows: (doc_id, text) -> (held_out, n_tokens, n_known, train_tokens, base_score, score) each."""
    tok = [WORD.findall(lower(t)) + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    c, c2, docs = collections.Counter(), collections.Counter(), 0
    for t, h in zip(tok, held):
        if not h:
            c.update(t)
            c2.update(zip(["^", *t], t))
            docs += 1
    n, v = sum(c.values()), len(c)
    out = []
    for t, h in zip(tok, held):
        p1 = [(c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in t]
        score = 0.0
        for u, w, p in zip(["^", *t], t, p1):
            cu = docs if u == "^" else c[u]
            score += math.log10(c2[(u, w)] / (cu + mu) + mu / (cu + mu) * p) if cu else math.log10(p)
        out.append((h, len(t), sum(c[w] > 0 for w in t), n, sum(map(math.log10, p1)), score))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    t, sp = text or "", []
    sp += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    sp += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    sp += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 32]
    return sorted(sp)


def bm25(docs, queries, k, k1=1.2, b=0.75):
    """docs, queries: (id, text) -> (query_id, rank, doc_id, score)."""
    tf = [collections.Counter(WORD.findall(lower(t))) for _, t in docs]
    n, mean = len(docs), sum(sum(x.values()) for x in tf) / max(1, len(docs))
    df = collections.Counter(w for x in tf for w in x)
    out = []
    for q, t in queries:
        if q is None:
            continue
        ask = collections.Counter(WORD.findall(lower(t)))
        found = []
        for (i, _), x in zip(docs, tf):
            dl = sum(x.values())
            s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * x[w] * (k1 + 1) / (x[w] + k1 * (1 - b + b * dl / mean))
                    for w, m in ask.items() if w in x)
            if any(w in x for w in ask):
                found.append((-round(s * 1e6) / 1e6, i is None, i or 0, i))
        out += [(q, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


# 11 -----------------------------------------------------------------------------------------------

def words(rows):
    """Counts of the words of operator 11."""
    n = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def variants(n):
    """Rows of operator 11 for word counts, by trying every edit over the letters that occur."""
    letters, out, form = sorted({c for w in n for c in w}), [], {}
    near = {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            for x in [w[:i] + w[i + 1:], *[w[:i] + c + w[i + 1:] for c in letters if c != w[i]]]:
                if x in n:
                    near[w].add(x)
                    near[x].add(w)
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


# 12 -----------------------------------------------------------------------------------------------

def _xx(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v % 2 ** 64).to_bytes(8, "little"), seed)
    return seed


def sketch(text, fraction=8, floor=48):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = [_xx([x.encode()]) for x in re.findall("[^ \t-\r]+", low)]
    if len(w) >= 5:
        hs = [_xx(w[i:i + 5]) for i in range(len(w) - 4)]
    else:
        h = 5
        for x in w:
            h = _xx([h, x])
        hs = [h] if w else []
    hs = sorted({h >> 2 for h in hs})
    limit = 2 ** 62 // fraction
    below = [h for h in hs if h < limit]
    if len(hs) <= floor:
        return 2 ** 62 - 1, hs
    return (limit, below) if len(below) >= floor else (hs[floor - 1] + 1, hs[:floor])


def likeness(a, b):
    bound = min(a[0], b[0])
    x, y = ({h for h in s[1] if h < bound} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def neighbours(rows):
    """Rows of operator 12."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), _xx([r[1].encode()]) - (2 ** 64 if _xx([r[1].encode()]) >= 2 ** 63 else 0)))
    out, digits = [], lambda s: "".join(f"{h:016x}" for h in [s[0], *s[1]])
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        e = t[:len(t) - len(t) // 3] + after[:len(t) // 3]
        a, b, c = sketch(t), sketch(e), sketch(after)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), digits(a), digits(b), likeness(a, b), likeness(a, c)))
    return out


# 13 -----------------------------------------------------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle(rows):
    """Rows of operator 13 for (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    trees = collections.defaultdict(list)
    for i, s, lang, n, t in rows:
        leaf = H(*map(field, (i, s, lang, n, t)))
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        trees[lang].append((i is not None, i or 0, leaf, H(*map(field, (i, s, lang, n, low(t)))) if hit else leaf, i))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][k:k + 8]) for k in range(0, len(out[-1]), 8)])
        return out

    def way(tree, i):
        for nodes in tree[:-1]:
            a = i - i % 8
            yield i % 8, nodes[a:i] + nodes[i + 1:a + 8]
            i //= 8

    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: levels([r[2] for r in sorted(trees[x], key=lambda r: r[:3])]) for x in order}
    top = levels([own[x][-1][0] for x in order])
    out = []
    for k, x in enumerate(order):
        for j, (_, _, leaf, changed, i) in enumerate(sorted(trees[x], key=lambda r: r[:3])):
            steps = [*way(own[x], j), *way(top, k)]
            d = changed
            for slot, others in steps:
                d = H(*others[:slot], d, *others[slot:])
            out.append((i, leaf, own[x][-1][0], top[-1][0], H(*[o for _, others in steps for o in others]), d, d == top[-1][0]))
    return out
