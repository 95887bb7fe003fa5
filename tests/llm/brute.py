"""Plain, slow versions of the operators, for small tables. They share no code with them."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def key(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(docs, window=20):
    first = {}
    for d, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (math.inf, 0)), (key(d), i))
    out = []
    for d, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (key(d), i):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def simhash(docs, shingle=4, distance=4):
    prints = []
    for d, text in docs:
        w = words(lower(text))
        grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) > shingle else [" ".join(w)] if w else []
        hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        prints.append((d, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    fps = sorted({p for _, p in prints})
    array = np.array(fps, np.uint64)
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= distance):
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    least = {}
    for d, p in prints:
        r = root(fps.index(p))
        least[r] = min(least.get(r, math.inf), key(d))
    shown = lambda k: None if k == key(None) else k
    return [(d, f"{p:016x}", shown(least[root(fps.index(p))])) for d, p in prints]


def quality(docs):
    out = []
    for d, text in docs:
        text = text or ""
        w = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        seen, dup = set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed))
    return out


def line_dedup(docs, least=10):
    strip = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))
    line_key = lambda x: lower(x.strip(strip))
    holders = defaultdict(set)
    for d, text in docs:
        for x in (text or "").split("\n"):
            if len(line_key(x)) >= least:
                holders[line_key(x)].add(key(d))
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(line_key(x), ())) < 2 or min(holders[line_key(x)]) == key(d)]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def mix_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """sizes: source -> size."""
    sources = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, rest, open_ = {}, share * sum(sizes.values()), set(sources)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
        rest -= sum(target[s] for s in over)
        open_ -= over
    return target


def licenses(docs):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    out = []
    for d, text in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        found = [(i, label) for i in range(len(w)) for p, label in phrases.items() if tuple(w[i : i + len(p)]) == p]
        at = [i for i, _ in found]
        out.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    return out


def license_labels(text, templates, containment=0.8):
    """label -> best share of the template's words in a block of so many words and half as many again."""
    out = {}
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    for t, label in templates.items():
        need, n = set(t.split()), len(t.split())
        best = max((len(need.intersection(w[i : i + n + (n + 1) // 2])) for i in range(len(w))), default=0)
        if best >= containment * len(need) - 1e-9:
            out[label] = max(out.get(label, 0), best / len(need))
    return out


def nearest(vectors, every=100, k=10):
    good = [(i, np.array(v, float)) for i, v in vectors if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    ids = np.array([i for i, _ in good])
    array = np.stack([v for _, v in good])
    for row in np.flatnonzero(ids % every == 0).tolist():
        distance = np.sqrt(((array - array[row]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, distance)) if i != row][:k]
        out[int(ids[row])] = [(int(ids[i]), float(distance[i])) for i in order]
    return out


def check_packing(rows, docs, tokenizer, capacity=2048):
    """rows: doc_id, piece, start, length, crc, sequence, offset. Returns (sequences, least possible)."""
    wanted = []
    for d, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            wanted.append((d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r[:5]) for r in rows), key=order) == sorted(wanted, key=order)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r[5]].append((r[6], r[3]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), math.ceil(sum(r[3] for r in rows) / capacity)


def toxic_features(text, insults, threats, second, odds):
    """name -> value of the features that are counts of words, and of nearness, by loops over all words."""
    w = re.findall(r"\w+(?:['’]\w+)*", text.lower())
    n = len(w)
    if not n:
        return {}
    near = lambda places: sum(1 / max(1, min(abs(i - j) for j, y in enumerate(w) if y in second)) for i in places) if any(y in second for y in w) else 0.0
    rude = [i for i, x in enumerate(w) if x in insults]
    known = [i for i, x in enumerate(w) if x in odds]
    return {
        "insults": len(rude), "threats": sum(x in threats for x in w), "learned": sum(odds[w[i]] for i in known), "learned_top": max((odds[w[i]] for i in known), default=0.0),
        "insult_rate": 100 * len(rude) / n, "learned_rate": 100 * len(known) / n, "second_person": 100 * sum(x in second for x in w) / n, "near_insult": near(rude), "near_learned": near(known),
        "exclamations": sum(c == "!" for c in text) / n, "log_words": math.log(1 + n), "repeats": 1 - len(set(w)) / n,
    }


def best_gain(x, grad, hess, least, ridge):
    """The greatest gain of any split of these rows at any value of any feature."""
    g, h, best = sum(grad), sum(hess), 0.0
    for f in range(x.shape[1]):
        for cut in sorted(set(x[:, f]))[:-1]:
            left = x[:, f] <= cut
            gl, hl = grad[left].sum(), hess[left].sum()
            if hl >= least and h - hl >= least:
                best = max(best, gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge))
    return best


def monotone_fit(score, y, prior):
    """Isotonic levels of each row by the min-max formula over blocks of scores, with half a row of the prior in each block found."""
    order = sorted(range(len(y)), key=lambda i: (score[i], i))
    v = [y[i] for i in order]
    n = len(v)
    sums = [0.0]
    for a in v:
        sums.append(sums[-1] + a)
    plain = [max(min((sums[j + 1] - sums[i]) / (j + 1 - i) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
    level, out, a = 0.0, [0.0] * n, 0
    while a < n:
        b = a
        while b + 1 < n and abs(plain[b + 1] - plain[a]) < 1e-12:
            b += 1
        level = max(level, (sum(v[a : b + 1]) + 0.5 * prior) / (b - a + 1.5))
        for k in range(a, b + 1):
            out[order[k]] = level
        a = b + 1
    return out


class _Visible(HTMLParser):
    """The words of what is outside of hidden elements, by the standard library's parser."""

    HIDDEN = frozenset("script style head title template noscript iframe object canvas audio video select datalist".split())
    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.VOID:
            self.out.append(" ")
            return
        style = re.sub(r"\s", "", (a.get("style") or "").lower())
        hidden = tag in self.HIDDEN or "hidden" in a or "display:none" in style or "visibility:hidden" in style
        self.stack.append((tag, hidden))
        self.out.append(" ")

    def handle_endtag(self, tag):
        self.out.append(" ")
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(h for _, h in self.stack):
            self.out.append(data)


def visible_letters(page):
    """All visible letters and digits of a page, in order."""
    parser = _Visible()
    parser.feed(page)
    parser.close()
    return re.sub(r"[\W_]+", "", "".join(parser.out))


def damaged(rows):
    """Rows (conv_id, turn, role, text) with faults put in."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults(turns):
    """The fault of each (role, text)."""
    seen, out = set(), []
    for role, text in turns:
        letters = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest_edits(turns):
    """(cost, audit, repaired turns) by a search over every edit from the back: the least pair of cost and audit."""
    found, bad = [None] * (len(turns) + 1), faults(turns)
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    for i in range(len(turns), -1, -1):
        best = {s: (0, "", ()) if i == len(turns) and s in ("", "a") else (math.inf, "", ()) for s in follow}
        if i < len(turns):
            (role, text), fault, after = turns[i], bad[i], found[i + 1]
            more = 3 if fault == "truncated" else 0
            for s, moves in follow.items():
                ways = [(4, "D", s, ())]
                if fault not in ("blank", "duplicate"):
                    if role[:1] in moves:
                        ways.append((more, "K", moves[role[:1]], ((role, text),)))
                    ways += [(3 + more, "R", t, ((names[c], text),)) for c, t in moves.items() if c in names]
                best[s] = min((cost + after[t][0], edit + after[t][1], kept + after[t][2]) for cost, edit, t, kept in ways)
        for _ in range(3):  # turns put in before this one
            for s, moves in follow.items():
                for c, t in moves.items():
                    if c in names:
                        best[s] = min(best[s], (3 + best[t][0], "I" + best[t][1], ((names[c], ""),) + best[t][2]))
        found[i] = best
    return found[0][""]


def repair(rows, ids):
    """Rows of conversation repair."""
    out = []
    for conv in set(ids):
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns, numbers = [r[1:] for r in own], {r[0] for r in own} - {None}
        cost, audit, kept = cheapest_edits(turns)
        bad, roles = faults(turns), [r[:1] for r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out.append((conv, gaps, *(bad.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept))))
    return out


def tree(nodes):
    """(top, path of each node): what is left of hashing every two, and the siblings left and right on the way."""
    level, at, paths = list(nodes), list(range(len(nodes))), [[] for _ in nodes]
    while len(level) > 1:
        for i, p in enumerate(at):
            first = p - p % 2
            paths[i].append((level[first:p], level[p + 1 : first + 2]))
        level, at = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)], [p // 2 for p in at]
    return level[0], paths


def merkle(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    shown = lambda *values: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, shown(*r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([x[2] for x in sorted(langs[k], key=lambda x: x[:3])]) for k in order]
    root, above = tree([t[0] for t in trees]) if trees else ("", [])
    out = []
    for k, (subroot, paths), on in zip(order, trees, above, strict=True):
        for (_, _, leaf, r), path in zip(sorted(langs[k], key=lambda x: x[:3]), paths, strict=True):
            steps, node = path + on, leaf
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                node = shown(*r[:3], r[3] + 1, r[4])
            for left, right in steps:
                node = sha("".join([*left, node, *right]))
            out.append((r[0], leaf, subroot, root, sha("".join(x for left, right in steps for x in left + right)), node, node == root))
    return out


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


PRIVATE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def private(text):
    """(start, kind, end) by the patterns as they are stated."""
    out = []
    for i, (kind, pattern) in enumerate(PRIVATE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good and (kind != "ip" or all(x.lstrip("0").rjust(3, "0") <= "255" and len(x.lstrip("0")) < 4 for x in m[0].split("."))):
                out.append((m.start(), i, kind, m.end()))
    return [(s, k, e) for s, _, k, e in sorted(out)]


def sanitise(docs, near=8, shortest=3, support=3, disclosure=0.9, stem=4):
    """(doc_id, base, spans) by the definitions, with the whole corpus in dictionaries."""
    name = lambda k, v: (k, v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v))
    held, words_in, together, places = defaultdict(set), defaultdict(set), defaultdict(set), []
    for row, (_, text) in enumerate(docs):
        text = text or ""
        spans = private(text)
        tokens = [(m.start(), m.end(), lower(m[0])) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        for _, _, w in tokens:
            words_in[w].add(row)
        free = [t for t in tokens if all(t[1] <= s or t[0] >= e for s, _, e in spans)]
        for s, k, e in spans:
            held[name(k, text[s:e])].add(row)
            for a, b, w in [t for t in free if t[1] <= s][-near:] + [t for t in free if t[0] >= e][:near]:
                if len(w) >= shortest:
                    together[name(k, text[s:e]), w].add(row)
                    places.append((row, name(k, text[s:e]), w, a, b))
    n = len(docs)

    def told(both, entity, term):
        return math.log(both * n / (len(held[entity]) * term)) / math.log(n / len(held[entity])) if len(held[entity]) < n else 0

    risky = {}
    for (entity, w), rows in together.items():
        if len(rows) >= support and told(len(rows), entity, len(words_in[w])) >= disclosure - 1e-12:
            same = sum(len(r) for (x, v), r in together.items() if x == entity and v[:stem] == w[:stem] and len(r) >= support)
            most = max(len(r) for v, r in words_in.items() if v[:stem] == w[:stem])
            risky[entity, w] = "generalised" if len(w) > stem and told(min(same, len(held[entity])), entity, most) < disclosure else "removed"
    found = defaultdict(dict)
    for row, entity, w, a, b in places:
        if kind := risky.get((entity, w)):
            found[row][a, b] = max(kind, found[row].get((a, b), ""))
    order = {k: i for i, k in enumerate(PRIVATE)}
    return [(d, (base := private(t)), sorted(base + [(a, k, b) for (a, b), k in found[row].items()], key=lambda x: (x[0], order.get(x[1], -1)))) for row, (d, t) in enumerate(docs)]
