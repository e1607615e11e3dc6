"""Plain-Python versions of the contracts, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def contaminated(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[p : p + n]), set()).add(str(i) if i is not None else "null")
    out = []
    for d, t in docs:
        w = ALNUM.findall(low(t))
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for p in range(len(w) - n + 1):
                k = tuple(w[p : p + n])
                if k in wins:
                    hit |= set(range(p, p + n))
                    found |= wins[k]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def base_quality(t):
    w = WORD.findall(t or "")
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover),
            n < 50 or 100 * len(cover) > 50 * n)


def components(docs, k=5):
    sets = []
    for d, t in docs:
        w = WORD.findall(low(t))
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                root[find(a)] = find(b)
    low_id = {}
    for i, (d, _) in enumerate(docs):
        low_id[find(i)] = min(low_id.get(find(i), d), d)
    return [(d, len(sets[i]), low_id[find(i)]) for i, (d, _) in enumerate(docs)]


def word_repeats(docs, window=13):
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.append((d, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def byte_repeats(docs, window=50):
    raw = [(d, (t or "").encode()) for d, t in docs]
    first = {}
    for d, b in raw:
        for i in range(len(b) - window + 1):
            key = b[i : i + window]
            first[key] = min(first.get(key, d), d)
    out = []
    for d, b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < d:
                gone[i : i + window] = [True] * window
        runs = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for j, x in enumerate(b) if not gone[j]))))
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def pii(t):
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d) if d else 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    out.sort()
    n = tuple(sum(k == i for _, k, _, _ in out) for i in range(4))
    return (*n, sha(",".join(f"{kind}:{s}:{e}" for s, _, e, kind in out))), [(s, e) for s, _, e, _ in out]
