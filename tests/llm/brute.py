"""Plain, slow versions of the operators that tests hold the real ones against."""

import hashlib
import itertools
import math
import re
import unicodedata
from collections import defaultdict

import numpy as np

from marlstone.llm import secret_scan


def shingles(text, n=5):
    """Five-word shingles, each with how often it came before."""
    words = re.findall(r"\w+", "".join(c for c in (text or "").lower() if c == "_" or not unicodedata.category(c).startswith("C")))
    seen, out = defaultdict(int), set()
    for k in range(len(words) - n + 1) if len(words) >= n else range(min(len(words), 1)):
        s = tuple(words[k : k + n])
        out.add((s, seen[s]))
        seen[s] += 1
    return out


def near_classes(rows, similarity=0.8):
    """rows of (id, text): for each row the place of its class's first row."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        near = shared >= similarity * (len(sets[a]) + len(sets[b]) - shared) if sets[a] and sets[b] else rows[a][1] == rows[b][1]
        if near and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    return label


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """sizes {source: words}: {source: target}, by sharing out, capping and sharing again."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, target, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: float(most * sizes[s]) for s in full}
        open_ -= full
    return target


def mixed(rows, share=1.5, most=2, seed="mix-1"):
    """rows of (id, source, text): the words that each row gives to the mix in each pass, by serving all entries in order of finish time."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    key = [int(md5(f"{seed}:{'' if i is None else i}:{md5(t or '')}")[:15], 16) for i, _, t in rows]
    whole = defaultdict(int)
    for (_, source, _), n in zip(rows, size, strict=True):
        whole[source] += n
    target, entries = targets(whole, share=share, most=most), []
    for source in whole:
        done = 0
        for k in sorted((k for k, r in enumerate(rows) if r[1] == source), key=lambda k: (key[k], rows[k][0] is not None, rows[k][0] or 0, size[k])):
            done += size[k]
            if size[k] and target[source] > 0:
                entries += [((done + turn * whole[source]) / target[source], key[k], k, turn) for turn in range(most)]
    left, taken = math.floor(share * sum(size)), [[0] * most for _ in rows]
    for _, _, k, turn in sorted(entries):
        taken[k][turn] = min(left, size[k])
        left -= taken[k][turn]
    return size, taken


def masked(text, mask="[secret]"):
    """The text with all secrets masked, and whether there were any."""
    base, more = [], []
    for rule in (*secret_scan.BASE_RULES, *secret_scan.MORE_RULES):
        whole = re.compile(rule.keep or "(?s).*")
        spans = [m.span() for m in secret_scan.compiled(rule).finditer(text or "") if whole.fullmatch(m[0])]
        (base if rule in secret_scan.BASE_RULES else more).extend(spans)
    more = [s for s in more if not any(s[0] < b[1] and b[0] < s[1] for b in base)]
    out, at = [], 0
    for start, end in sorted(base + more):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + (text or "")[at:] if base or more else text, bool(base or more)


def phrases(symbols):
    """Locally consistent parsing of one list of symbols, a symbol at a time: the names of its phrases."""
    mask, c = 2**64 - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & mask
        return x ^ (x >> 32)

    def coin(before, own):
        at = next((b for b in range(7) if (before ^ own) >> b & 1), 7)
        return 2 * at + (own >> at & 1)

    whole = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
    runs = [s if n == 1 else mix((s + n * c) & mask) for s, n in whole]
    labels = [runs[0] & 1]
    for a, b in itertools.pairwise(runs):
        at = next(k for k in range(64) if (a ^ b) >> k & 1)
        labels.append((2 * at + (b >> at & 1)) & 127)
    for _ in range(3):
        labels = [labels[0] & 1, *(coin(a, b) for a, b in itertools.pairwise(labels))]
    out = []
    for i, s in enumerate(runs):
        peak = i > 0 and labels[i] > labels[i - 1] and (i == len(runs) - 1 or labels[i] > labels[i + 1])
        if i == 0 or peak:
            out.append([])
        out[-1].append(s)
    return [mix((sum(mix((s + k * c) & mask) for k, s in enumerate(p)) + len(p)) & mask) for p in out]


def private_spans(text, base, trees, cuts):
    """(kind, start, finish) of the looser formats that the trees accept, outside of the base spans (start, finish)."""
    from marlstone.llm import pii

    out = set()
    for number, kind in enumerate(pii.KINDS):
        for m in re.finditer(pii.MORE[kind], text, re.ASCII):
            if any(m.start() < f and s < m.end() for s, f in base):
                continue
            found, before, after = m[0], text[max(0, m.start() - pii.CONTEXT) : m.start()], text[m.end() : m.end() + 2]
            digits, separators = re.sub("[^0-9]", "", found), re.sub("[A-Za-z0-9]", "", found)
            total = sum((2 * int(d) - 9 * (int(d) > 4)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
            row = {
                "kind": number, "digits": len(digits), "length": len(found), "separators": len(separators), "parens": "(" in found, "luhn": bool(digits) and total % 10 == 0,
                "distinct_digits": max(1, len(set(digits))), "for": bool(re.search(pii.FOR, before)), "against": bool(re.search(pii.AGAINST, before)), "word_before": bool(re.search("[A-Za-z]$", before)),
                "word_after": bool(re.match("[A-Za-z]", after)), "zero_start": digits.startswith("0"), "same_separator": len([k for k, _ in itertools.groupby(separators)]) <= 1,
            }
            if trees.score(np.array([[float(row[n]) for n in pii.FEATURES]]))[0] >= cuts[kind]:
                out.add((kind, m.start(), m.end()))
    return out
