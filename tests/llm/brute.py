"""Plain Python versions of the operators' base results, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def pii(text: str | None) -> dict:
    spans = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if ok:
                spans.append((m.start(), k, kind, m.end()))
    spans.sort()
    listed = [f"{kind}:{start}:{end}" for start, _, kind, end in spans]
    counts = Counter(s[2] for s in spans)
    return {
        **{f"n_{k}": counts[k] for k in PII},
        "base_sha256": hashlib.sha256(",".join(listed).encode()).hexdigest(), "listed": listed,
    }


def quality(text: str | None) -> dict:
    text = text or ""
    found = WORDS.findall(text)
    windows = [tuple(found[i:i + 8]) for i in range(len(found) - 7)]
    times = Counter(windows)
    covered = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(found)
    return {
        "n_words": n, "word_chars": sum(map(len, found)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup, "n_repeat_words": len(covered), "base_failed": n < 20 or 100 * len(covered) > 30 * n,
    }


def repeats(texts: dict[int, str | None], width: int = 35) -> dict[int, tuple[int, int, str]]:
    """Per row key: words, removed words and the digest of the kept ones."""
    split = {k: WORDS.findall(t or "") for k, t in texts.items()}
    times = Counter(tuple(w[i:i + width]) for w in split.values() for i in range(len(w) - width + 1))
    out = {}
    for k, w in split.items():
        gone = {p for i in range(len(w) - width + 1) if times[tuple(w[i:i + width])] > 1 for p in range(i, i + width)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), {s for s in names if not sizes[s]}
    while free := [s for s in names if s not in capped]:
        unit = (budget - sum(most * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > most * sizes[s]}
        if not over:
            break
        capped |= over
    return {s: float(most * sizes[s]) if s in capped else unit * weight[s] for s in names}
