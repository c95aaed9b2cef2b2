"""Plain versions of the operators, for small inputs."""

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text, n):
    w = WORDS.findall(fold(text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near_components(rows, n, percent):
    """{doc_id: component} by comparing all pairs."""
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets}


def without_repeats(rows):
    """{doc_id: text} after three-line dedup; rows are (doc_id, text) with distinct ids."""
    first, found = {}, []
    for doc, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        places = [i for i, line in enumerate(text.split("\n")) if WORDS.search(line)]
        lines = [text.split("\n")[i] for i in places]
        for at in range(len(lines) - 2):
            key = tuple(lines[at : at + 3])
            first.setdefault(key, (doc, at))
            found.append((doc, at, key, places))
    gone = defaultdict(set)
    for doc, at, key, places in found:
        f_doc, f_at = first[key]
        if (doc, at) != (f_doc, f_at):
            gone[doc].update(places[k] for k in range(at, at + 3) if doc != f_doc or k >= f_at + 3)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


def quality_counts(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def shared_targets(sizes, weights, most):
    """Targets of (source, size) pairs by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        rest = total - sum(most * sizes[s] for s in stopped)
        out = {s: most * sizes[s] if s in stopped else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if out[s] > most * sizes[s]}
        if not over:
            return out
        stopped |= over


def base_spans(text):
    """Personal data by the regular expressions themselves."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        luhn = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and luhn % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def linked_vectors(rows, cosine):
    """{number: (links, component)} of (vec_id, label, vector) rows by comparing all pairs; the component is a vec_id."""
    ok = [k for k, (i, label, v) in enumerate(rows) if i is not None and label is not None and v
          and all(x is not None and abs(x) < float("inf") for x in v) and any(v)]
    links, parent = Counter(), {k: k for k in range(len(rows))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(ok, 2):
        (_, p, v), (_, q, w) = rows[a], rows[b]
        if p == q and len(v) == len(w):
            top = max(map(abs, v)), max(map(abs, w))
            v, w = [x / top[0] for x in v], [x / top[1] for x in w]
            if sum(x * y for x, y in zip(v, w)) / (sum(x * x for x in v) * sum(x * x for x in w)) ** 0.5 >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    parts = defaultdict(list)
    for k in parent:
        parts[root(k)].append(k)
    return {k: (links[k], min((rows[m][0] for m in of), default=None) if len(of) > 1 else rows[k][0]) for of in parts.values() for k in of}


def lexical_ranks(docs, items, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item; docs are (doc_id, text)."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    said = [(d, Counter(term.findall(fold(t or "")))) for d, t in docs]
    said = [(d, c) for d, c in said if c]
    total, df = sum(sum(c.values()) for _, c in said), Counter(t for _, c in said for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item].update(term.findall(fold(text or "")))
    out = []
    for item, of in asked.items():
        scored = []
        for at, (d, c) in enumerate(said):
            n = sum(c.values())
            m = 10 + 90 * n * len(said) // total
            score = sum(math.floor(1000 * math.log((2 * len(said) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in of if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, n, at))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d, _, _) in enumerate(sorted(scored)[:k])]
    return out


def aligned_groups(a, b):
    """[(left tokens, right tokens)] of (id, bytes) lists, None if their bytes differ."""
    if b"".join(x for _, x in a) != b"".join(x for _, x in b):
        return None
    out, at, to = [([], [])], [0, 0], [list(a), list(b)]
    while to[0] or to[1]:
        side = 0 if to[0] and (at[0] <= at[1] or not to[1]) else 1
        i, said = to[side].pop(0)
        out[-1][side].append(i)
        at[side] += len(said)
        if at[0] == at[1]:
            out.append(([], []))
    return out[:-1]


def overlaps(a, b):
    """Id pairs of tokens that share a byte."""
    def spans(tokens):
        at = 0
        for i, said in tokens:
            yield i, at, at + len(said)
            at += len(said)
    right = list(spans(b))
    return [(i, j) for i, s, e in spans(a) for j, t, f in right if s < f and t < e]


def believed_patterns(edges, rounds, confident, support):
    """{pattern: confidence} of (pattern, instance, seed) edges after some rounds."""
    instances, patterns = defaultdict(set), defaultdict(set)
    seeds = set()
    for pattern, instance, seed in edges:
        instances[instance].add(pattern)
        patterns[pattern].add(instance)
        if seed:
            seeds.add(instance)
    score = {i: float(i in seeds) for i in instances}
    for _ in range(rounds):
        believed = {}
        for pattern, of in patterns.items():
            confidence = sum(score[i] for i in of) / (len(of) + 1)
            if confidence >= confident and sum(score[i] >= confident for i in of) >= support:
                believed[pattern] = confidence
        score = {i: max(float(i in seeds), 1 - math.prod(1 - believed.get(p, 0.0) for p in of)) for i, of in instances.items()}
    return believed


def quality_features(text):
    """The features of the additive model, by regular expressions."""
    text = text or ""
    c, w = quality_counts(text), WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n, upper, lower = max(len(w), 1), len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    chars = max(len(text), 1)
    return [
        math.log(1 + len(w)), c["word_chars"] / n, c["n_symbols"] / n, c["n_dup_lines"] / max(len(lines), 1), c["n_repeat_words"] / n,
        upper / max(upper + lower, 1), len(re.findall("[0-9]", text)) / chars, len(re.findall("[!?]", text)) / n, len(re.findall("[.,;:]", text)) / n,
        len(set(w)) / n, math.log(1 + len(lines)), len(w) / max(len(lines), 1), (len(text.encode()) - len(text)) / chars,
        math.log(1 + max((len(x.encode()) for x in w), default=0)),
    ]


def best_cut(g, h, ridge):
    """(gain, cut) of the best split of ordered bins in two."""
    worth = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + ridge)
    return max((worth(0, k) + worth(k, len(g)) - worth(0, len(g)), -k) for k in range(1, len(g)))
