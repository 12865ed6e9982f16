"""Plain-Python second implementations, used only to compare against."""

import math
from collections import Counter
from itertools import groupby

PUNCT = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def sentences(text):
    out, current = [], ""
    for ch in " ".join(text.split()):
        if ch in ".!?؟؛;。！？":
            out.append(current)
            current = ""
        else:
            current += ch
    return [s.strip() for s in [*out, current] if s.strip()]


def repeated_grams(tokens, n):
    grams = [tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1)]
    return 0.0 if len(tokens) < 2 * n else 1 - len(set(grams)) / len(grams)


def longest_run(tokens):
    longest = max((len(list(g)) for _, g in groupby(tokens)), default=0)
    return 1 - math.exp(-max(0, longest - 3) / 8)


def repeated_sentences(text):
    counts = Counter(s for s in sentences(text) if len(s) >= 10)
    total = sum(counts.values())
    if total < 2:
        return 0.0
    return max(sum(c for c in counts.values() if c > 1), max(counts.values())) / total


def looping(text):
    s = sentences(text)
    if len(s) < 6:
        return 0.0
    cover = max(
        sum(s[i] == s[i % p] for i in range(len(s))) / len(s) for p in range(1, min(6, len(s) // 3) + 1)
    )
    return min(1.0, max(0.0, (cover - 0.6) / 0.4))


def chrf_tokens(text):
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in PUNCT:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in PUNCT:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def gram_counter(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def chrf_stats(hyp, ref):
    stats = []
    for tokens, orders in (((lambda t: list("".join(t.split()))), range(1, 7)), (chrf_tokens, (1, 2))):
        for n in orders:
            h, r = gram_counter(tokens(hyp), n), gram_counter(tokens(ref), n)
            m = sum(min(c, r[g]) for g, c in h.items())
            stats.append((sum(h.values()) if r else 0, sum(r.values()), m))
    return stats


def chrf_of(stats):
    used = [(h, r, m) for h, r, m in stats if h > 0 and r > 0]
    if not used:
        return 0.0
    p = sum(m / h for h, _, m in used) / len(used)
    r = sum(m / n for _, n, m in used) / len(used)
    return 5 * p * r / (4 * p + r) if p + r > 0 else 0.0


def chrf(hyp, ref):
    return chrf_of(chrf_stats(hyp, ref))


def bleu(pairs):
    totals = [[0, 0] for _ in range(4)]
    sys_len = sum(len(h) for h, _ in pairs)
    ref_len = sum(len(r) for _, r in pairs)
    for h, r in pairs:
        for n in range(1, 5):
            hc, rc = gram_counter(h, n), gram_counter(r, n)
            totals[n - 1][0] += sum(hc.values())
            totals[n - 1][1] += sum(min(c, rc[g]) for g, c in hc.items())
    if not any(m for _, m in totals) or any(t == 0 for t, _ in totals):
        return 0.0
    smooth, logs = 1.0, 0.0
    for t, m in totals:
        if m == 0:
            smooth *= 2
            logs += math.log(1 / (smooth * t))
        else:
            logs += math.log(m / t)
    brevity = math.exp(1 - ref_len / sys_len) if sys_len < ref_len else 1.0
    return 100 * brevity * math.exp(logs / 4)
