"""Plain single-process versions of the operators, for comparison."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def warc(pages, least=0):
    payload = [(i, (h or "").encode()) for i, h in pages]
    groups = defaultdict(list)
    for i, p in payload:
        groups[p].append(i)
    out = []
    for i, p in payload:
        ids = [x for x in groups[p] if x is not None]
        first = max(ids) if ids and len(groups[p]) > 1 and len(p) >= least else None
        refers = first if first is not None and i != first else None
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers))
    return out


def substring(docs, w=35):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    seen = Counter(tuple(x[k : k + w]) for _, x in words for k in range(len(x) - w + 1))
    out = []
    for i, x in words:
        gone = set()
        for k in range(len(x) - w + 1):
            if seen[tuple(x[k : k + w])] > 1:
                gone.update(range(k, k + w))
        out.append((i, len(x), len(gone), sha(" ".join(y for k, y in enumerate(x) if k not in gone))))
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items, w=10):
    window = defaultdict(set)
    for i, t in items:
        x = NORMAL.findall(lower(t))
        for k in range(len(x) - w + 1):
            window[tuple(x[k : k + w])].add(i)
        if 0 < len(x) < w:
            window[tuple(x)].add(i)
    sizes = {len(k) for k in window}
    out = []
    for i, t in docs:
        x, hit, found = NORMAL.findall(lower(t)), set(), set()
        for n in sizes:
            for k in range(len(x) - n + 1):
                if (key := tuple(x[k : k + n])) in window:
                    hit.update(range(k, k + n))
                    found |= window[key]
        out.append((i, len(x), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def lines(docs, s=0.8):
    split = lambda t: [set(re.split("[ \t\x0b\f\r]+", x)) - {""} for x in (t or "").split("\n")]
    order = sorted(((i, k, x) for i, t in docs for k, x in enumerate(split(t)) if x), key=lambda r: r[:2])
    gone = set()
    for n, (i, k, x) in enumerate(order):
        if any(len(x & y) >= s * len(x | y) - 1e-9 for _, _, y in order[:n] if s * len(x) <= len(y) + 1e-9 and s * len(y) <= len(x) + 1e-9):
            gone.add((i, k))
    return [(i, len((t or "").split("\n")), sum((i, k) in gone for k in range(len((t or "").split("\n")))), sha("\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone))) for i, t in docs]


def tokens(docs, path):
    from tokenizers import Tokenizer

    to = Tokenizer.from_file(path)
    out, start = [], 0
    for i, t in sorted(docs, key=lambda r: r[0]):
        ids = [*to.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


def shingles(text, n=5):
    x = WORD.findall(text or "")
    return frozenset(tuple(x[k : k + n]) for k in range(len(x) - n + 1)) or (frozenset([tuple(x)]) if x else frozenset())


def jaccard(docs, s=0.8):
    sets = [(i, shingles(t)) for i, t in docs]
    distinct = list(dict.fromkeys(x for _, x in sets))
    links, root = Counter(), list(range(len(distinct)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    owners = defaultdict(list)
    for k, x in enumerate(distinct):
        common = Counter(o for y in x for o in owners[y])
        for o, c in common.items():
            if c >= s * (len(x) + len(distinct[o]) - c) - 1e-9:
                links[k] += 1
                links[o] += 1
                root[max(find(k), find(o))] = min(find(k), find(o))
        for y in x:
            owners[y].append(k)
    number, copies = {x: k for k, x in enumerate(distinct)}, Counter(x for _, x in sets)
    least = {}
    for i, x in sets:
        r = find(number[x])
        least[r] = min(least.get(r, i), i)
    return [(i, least[find(number[x])], links[number[x]], copies[x]) for i, x in sets]


def quality(docs):
    out = []
    for i, t in docs:
        t = t or ""
        x, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4))
        hit = {j for k in range(len(x) - 4) if grams[tuple(x[k : k + 5])] > 1 for j in range(k, k + 5)}
        out.append((i, len(x), sum(map(len, x)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(x) < 10 or 100 * len(hit) > 20 * len(x)))
    return out


def poisson(u, mean):
    import math

    p = c = math.exp(-mean)
    k = 0
    while u >= c and k < 96:
        k += 1
        p *= mean / k
        c += p
    return k + (u >= c)
