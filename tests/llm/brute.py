"""The operators' results said plainly, for small tables: lists of dicts in, dicts by identifier out."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def bpe(docs, tokenizer):
    out = []
    for d in docs:
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids
        out.append((d["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    return out


def base_scores(docs):
    def tokens(d):
        return WORD.findall((d["text"] or "").translate(LOWER)) + [None]

    def remainder(d):
        return zlib.crc32(str(d["doc_id"]).encode()) % 5 if d["doc_id"] is not None else 0

    counts = Counter(t for d in docs if remainder(d) != 1 for t in tokens(d))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d in docs:
        t = tokens(d)
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        out.append((d["doc_id"], remainder(d) == 1, len(t), sum(counts[x] > 0 for x in t), n, base))
    return out


def exact(docs):
    groups = {}
    for d in docs:
        groups.setdefault(SPACE.sub(" ", d["text"] or ""), []).append(d["doc_id"])
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), place == 0, sha(text)) for place, i in enumerate(ids)]
    return out


def passages(docs, window=13):
    first = {}
    big = float("inf")
    for d in docs:
        own = big if d["doc_id"] is None else d["doc_id"]
        words = WORD.findall(d["text"] or "")
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            first[run] = min(first.get(run, big), own)
    out = []
    for d in docs:
        own = big if d["doc_id"] is None else d["doc_id"]
        words = WORD.findall(d["text"] or "")
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < own:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((d["doc_id"], len(words), len(gone), sha(" ".join(kept))))
    return out


def contamination(docs, items, window=13):
    def words(text):
        return BENCH_WORD.findall((text or "").translate(LOWER))

    windows = {}
    for item in items:
        w = words(item["text"])
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(None if item["item_id"] is None else str(item["item_id"]))
    lengths = {len(w) for w in windows}
    out = []
    for d in docs:
        w, hit, found = words(d["text"]), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (run := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[run]
        out.append((d["doc_id"], len(w), len(hit), len(found), sha(",".join(sorted(i for i in found if i is not None))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def roots(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(i) for i in range(n)]


def shingle_set(text, length=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + length]) for i in range(max(1, len(w) - length + 1)))


def similar(a, b, percent):
    both = len(a & b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def near(docs, percent=85):
    """For tables whose identifiers do not repeat."""
    docs = sorted(docs, key=lambda d: (d["doc_id"] is None, d["doc_id"] or 0))
    sets = [shingle_set(d["text"]) if d["doc_id"] is not None else frozenset() for d in docs]
    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    pairs = {(i, j) for m in index.values() for i in m for j in m if i < j}
    up = roots(len(docs), [(i, j) for i, j in pairs if similar(sets[i], sets[j], percent)])
    out = []
    for i, d in enumerate(docs):
        component = docs[up[i]]["doc_id"] if d["doc_id"] is not None else None
        out.append((d["doc_id"], len(shingle_set(d["text"])), component, d["doc_id"] is None or component == d["doc_id"]))
    return out


def fuzzy_lines(docs, length=9, percent=80):
    """(n_lines, removed places) for each document; identifiers do not repeat."""
    def canonical(line):
        return line.encode().strip().lower()

    places = []
    for d in sorted(docs, key=lambda d: (d["doc_id"] is None, d["doc_id"] or 0)):
        for no, line in enumerate((d["text"] or "").split("\n")):
            if canonical(line):
                places.append((d["doc_id"], no, canonical(line)))
    sets = [frozenset(x[i : i + length] for i in range(max(1, len(x) - length + 1))) for _, _, x in places]
    up = roots(len(places), [(i, j) for j in range(len(places)) for i in range(j) if similar(sets[i], sets[j], percent)])
    gone = {}
    for i, (doc, no, _) in enumerate(places):
        if up[i] != i:
            gone.setdefault(doc, []).append(no)
    return [(d["doc_id"], len((d["text"] or "").split("\n")), len(gone.get(d["doc_id"], [])), sorted(gone.get(d["doc_id"], []))) for d in docs]


def warc(pages):
    """One response for equal payloads of 100 bytes and more, that of the smallest page id."""
    first, seen, out = {}, set(), []
    for p in sorted(pages, key=lambda p: (p["page_id"] is None, p["page_id"] or 0)):
        raw = (p["html"] or "").encode()
        revisit = len(raw) >= 100 and raw in seen
        seen.add(raw)
        first.setdefault(raw, p["page_id"])
        out.append((p["page_id"], len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[raw] if revisit else None))
    return out


def whitening(rows, components=32):
    """rows: (id, list). Vectors of another length than the most frequent are left out by the caller."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[n * a - s for a, s in zip(v, sums)] for v in x], dtype=object)
    deviation = [sum(int(c) ** 2 for c in v) for v in centred]
    away = centred.astype(np.float64) / n
    values, axes = np.linalg.eigh(away.T @ away / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = []
    for (i, _), d, row in zip(kept, deviation, away @ axes):
        for k in range(min(components, len(values))):
            out.append((i, k + 1, n, d, abs(row[k]) / math.sqrt(values[k]) if values[k] > 1e-9 * values[0] else None, values[k] / values.sum()))
    return out


def licenses(docs, base, templates):
    """Templates as lists of words, ("any", fewest, most) and ("maybe", [...]), tried by backtracking."""
    def ends(parts, text, at):
        if not parts:
            return {at}
        part, rest = parts[0], parts[1:]
        if isinstance(part, str):
            return ends(rest, text, at + 1) if at < len(text) and text[at] == part else set()
        if part[0] == "maybe":
            return ends(rest, text, at) | {e for m in ends(part[1], text, at) for e in ends(rest, text, m)}
        return {e for k in range(part[1], part[2] + 1) if at + k <= len(text) for e in ends(rest, text, at + k)}

    out = []
    for d in docs:
        text = BENCH_WORD.findall((d["text"] or "").translate(LOWER))
        places = [(i, label) for label, parts in base for i in range(len(text)) if ends(parts, text, i)]
        labels = {label for label, parts in [*base, *templates] if any(ends(parts, text, i) for i in range(len(text)))}
        most = max((sum(isinstance(p, str) for p in parts) for label, parts in [*base, *templates] if any(ends(parts, text, i) for i in range(len(text)))), default=0)
        starts = [i for i, _ in places]
        out.append((d["doc_id"], len(text), len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), most / (most + 1)))
    return out


def audit(docs, labels):
    """docs with doc_id, text and source; labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    ids = {}
    for d in docs:
        ids.setdefault(d["text"] or "", []).append(d["doc_id"])
    fails, parts = [], sorted({d["source"] or "" for d in docs})
    for d in docs:
        text, own = d["text"] or "", d["doc_id"]
        w = WORD.findall(text)
        smaller = any(i is not None and (own is None or i < own) for i in ids[text])
        fails.append({"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                      "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller})
    out = []
    for part in parts:
        rows = [(f, d["doc_id"] in good, d["doc_id"] in toxic) for f, d in zip(fails, docs) if (d["source"] or "") == part]
        steps, total = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, 1):
                gone = [r for r in left if r[0][name]]
                left = [r for r in left if not r[0][name]]
                every = sum(r[0][name] for r in rows)
                unique = sum(r[0][name] and sum(r[0].values()) == 1 for r in rows)
                total[name] += len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), every - len(gone), unique, sum(r[1] for r in gone), sum(r[2] for r in gone), name))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return out
