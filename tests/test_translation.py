"""Translation scores against plain definitions: n-gram counts with counters, edits with moves by an exhaustive table."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from evalloom.functions import translation


def plain_table(hyp, ref):
    """Costs and first choices of the edit table within the beam."""
    n, m = len(hyp), len(ref)
    ratio = m / n if n else 1
    beam = math.ceil(ratio / 2 + 25) if 25 < ratio / 2 else 25
    cost = {(0, j): j for j in range(m + 1)}
    how = {(0, j): "missing" for j in range(1, m + 1)}
    for i in range(1, n + 1):
        middle = math.floor(i * ratio)
        for j in range(max(0, middle - beam), m + 1 if i == n else min(m + 1, middle + beam)):
            best = (math.inf, None)
            options = [(cost.get((i - 1, j - 1), math.inf) + (hyp[i - 1] != ref[j - 1]), "pair")] if j else []
            options.append((cost.get((i - 1, j), math.inf) + 1, "extra"))
            if j:
                options.append((cost.get((i, j - 1), math.inf) + 1, "missing"))
            for c, name in options:
                if c < best[0]:
                    best = (c, name)
            cost[i, j], how[i, j] = best
    return cost[n, m], how


def plain_ter(hyp, ref):
    """Edits with moves: the best single move again and again, word lists rebuilt and priced one at a time."""
    hyp, ref = hyp.lower().split(), ref.lower().split()
    if not hyp or not ref:
        return max(len(hyp), len(ref))
    moves = tried = 0
    while True:
        now, how = plain_table(hyp, ref)
        i, j, path = len(hyp), len(ref), []
        while i or j:
            name = how[i, j]
            i, j = i - (name != "missing"), j - (name != "extra")
            path.append((name, i, j))
        at, align, bad_h, bad_r = -1, {}, {}, {}
        for name, i, j in reversed(path):
            if name != "missing":
                at = i
                bad_h[i] = name == "extra" or hyp[i] != ref[j]
            if name != "extra":
                align[j] = at
                bad_r[j] = name == "missing" or hyp[i] != ref[j]
        best = None
        full = False
        for s in range(len(hyp)):
            for r in range(len(ref)):
                if abs(s - r) > 50 or full:
                    continue
                for size in range(1, 11):
                    if s + size > len(hyp) or r + size > len(ref) or hyp[s + size - 1] != ref[r + size - 1]:
                        break
                    if not any(bad_h[s + k] for k in range(size)) or not any(bad_r[r + k] for k in range(size)) or s <= align[r] < s + size:
                        continue
                    seen = None
                    for k in range(-1, size):
                        to = 0 if r + k == -1 else align[r + k] + 1
                        if to == seen:
                            continue
                        seen = to
                        if to < s:
                            new = hyp[:to] + hyp[s : s + size] + hyp[to:s] + hyp[s + size :]
                        elif to > s + size:
                            new = hyp[:s] + hyp[s + size : to] + hyp[s : s + size] + hyp[to:]
                        else:
                            new = hyp[:s] + hyp[s + size : size + to] + hyp[s : s + size] + hyp[size + to :]
                        tried += 1
                        rank = (now - plain_table(new, ref)[0], size, -s, -to)
                        if best is None or rank > best[0]:
                            best = (rank, new)
                    if tried >= 1000:
                        full = True
                        break
        if best is None or tried >= 1000 or best[0][0] <= 0:
            return moves + now
        moves, hyp = moves + 1, best[1]


def test_edits_equal_a_plain_search():
    rnd = random.Random(3)
    for k in range(300):
        words = [f"w{rnd.randrange(rnd.choice([3, 8, 30]))}" for _ in range(rnd.randrange(0, 14))]
        ref = list(words)
        for _ in range(rnd.randrange(4)):
            if len(ref) > 2:
                a, b = sorted(rnd.sample(range(len(ref)), 2))
                span = ref[a:b]
                del ref[a:b]
                at = rnd.randrange(len(ref) + 1)
                ref[at:at] = span
            if ref and rnd.random() < 0.5:
                ref[rnd.randrange(len(ref))] = rnd.choice(["X", "w1", "W2"])
            if rnd.random() < 0.3:
                ref.insert(rnd.randrange(len(ref) + 1), "new")
        got = translation.edits(" ".join(words), " ".join(ref))
        assert got == (plain_ter(" ".join(words), " ".join(ref)), len(ref)), (k, words, ref)


def test_known_edits():
    assert translation.edits("b c a", "a b c") == (1, 3)  # one move instead of two edits
    assert translation.edits("The CAT", "the cat") == (0, 2)
    assert translation.edits("", "a b") == (2, 2) and translation.edits("a b", "") == (2, 0) and translation.edits("", "") == (0, 0)
    long = [f"w{i}" for i in range(200)]
    assert translation.edits(" ".join(long[5:] + long[:5]), " ".join(long))[0] <= 10


def plain_scores(pairs):
    def tokens(s):
        s = s or ""
        for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            s = s.replace(a, b)
        out = "".join(f" {c} " if ord(c) < 127 and not c.isalnum() and c not in " ',-." else c for c in f" {s} ")
        for pattern in (r"([^0-9])([.,])", r"([.,])([^0-9])", r"([0-9])(-)"):
            out = re.sub(pattern, {0: r"\1 \2 ", 1: r" \1 \2"}[int(pattern.startswith("([.,]"))], out)
        return out.split()

    def grams(x, n):
        return Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))

    m, t, cm, cp, cr = ([0] * 7 for _ in range(5))
    c = r = ed = wl = 0
    for p, q in pairs:
        a, b = tokens(p), tokens(q)
        c, r = c + len(a), r + len(b)
        for n in range(1, 5):
            m[n] += sum((grams(a, n) & grams(b, n)).values())
            t[n] += sum(grams(a, n).values())
        x, y = "".join((p or "").split()), "".join((q or "").split())
        for n in range(1, 7):
            cm[n] += sum((grams(x, n) & grams(y, n)).values())
            cp[n] += sum(grams(x, n).values()) if grams(y, n) else 0
            cr[n] += sum(grams(y, n).values())
        ed += plain_ter(p or "", q or "")
        wl += len((q or "").split())
    score = 0.0
    if m[1] and t[4]:
        half, logs = 1, 0.0
        for n in range(1, 5):
            half *= 1 if m[n] else 2
            logs += math.log(m[n] / t[n] if m[n] else 1 / (half * t[n]))
        score = 100 * (1 if c >= r else math.exp(1 - r / c)) * math.exp(logs / 4)
    orders = [n for n in range(1, 7) if cp[n] and cr[n]]
    p, q = (sum(cm[n] / x[n] for n in orders) / max(1, len(orders)) for x in (cp, cr))
    return score, 0.0 if p + q == 0 else 100 * 5 * p * q / (4 * p + q), 100 * ed / wl if wl else 100.0 * (ed > 0)


@pytest.mark.parametrize("pairs", [
    [("the cat sat on the mat", "the cat sat on a mat"), ("Said: \"no-one\" paid $3,000.50 (or 10-12%)!", "He said: \"no-one\" paid $3,000.55, or 12-10%."), (None, "x y"), ("same &amp; text\nhere now", "same & text here now"), ("été à l'école", "l'été à l'école")],
    [("a b", "a b")], [("zz", "y y y y y")], [(None, None)], [("one two three four five", "one six three seven five")], [],
])
def test_scores_equal_definitions(spark, pairs):
    got = translation.corpus_scores(spark.createDataFrame(pairs, "pred string, ref string"), "pred", "ref").first()
    assert all(abs(a - b) < 1e-9 for a, b in zip((got.bleu, got.chrf, got.ter), plain_scores(pairs), strict=True)), (got, plain_scores(pairs))
