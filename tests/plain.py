"""The definitions once more, in plain Python, to compare whole columns with."""

import random
from collections import Counter
from itertools import groupby

SPACES = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
ALPHABET = (
    "aab b c..  \t\n1 2é²ßЖ_-" + SPACES + "\U0001f600\U0001f600\U0001d400中文的是́​—,，。"
)
LATIN = "aab b c..  \t\n1 2é²ß_-'😀"


def random_texts(n, seed, alphabet=ALPHABET, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(n)]


def repetitive_texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            unit = "".join(rng.choices("ab😀\n ", k=rng.randint(1, 4)))
            parts.append(unit * rng.randint(1, 5))
        out.append("".join(parts))
    return out


def spaced_token_set(text):
    keep = set()
    for word in text.split():
        fact = any(ch.isalpha() or (ch.isnumeric() and not ch.isdecimal()) for ch in word)
        if len(word) > 1 and fact:
            keep.add(word)
    return keep


def has_han(text):
    return any(0x4E00 <= ord(ch) <= 0x9FFF for ch in text)


def char_share(text):
    return Counter(text).most_common(1)[0][1] / len(text)


def phrase_run(text, more_than):
    """Longest run over aligned blocks, shortest phrase first, earliest first."""
    best = (0, None)
    for size in (2, 3, 4):
        if len(text) < 2 * size:
            continue
        blocks = [text[i : i + size] for i in range(0, len(text) - size + 1, size)]
        for block, same in groupby(blocks):
            times = len(list(same))
            if times > best[0]:
                best = (times, block)
    return best if best[0] > more_than else (None, None)


def relevance(answer, keywords):
    if not answer.strip():
        return 0.0
    if not keywords:
        return 100.0
    have = spaced_token_set(answer)
    found = [
        spaced_token_set(k) <= have if spaced_token_set(k) else k in answer for k in keywords
    ]
    return round(sum(found) / len(keywords) * 100, 2)


def completeness(answer, standard):
    if not answer.strip():
        return 0.0
    a, s = spaced_token_set(answer), spaced_token_set(standard)
    if not s:
        return 80.0
    return round((min(len(a) / len(s), 1.0) * 0.4 + len(a & s) / len(s) * 0.6) * 100, 2)


def risk(answer, standard, whitelist):
    if not answer.strip():
        return "无", set(), 0.0
    if not standard.strip():
        return "未知", set(), 0.0
    a = spaced_token_set(answer)
    extra = a - spaced_token_set(standard) - set(whitelist)
    ratio = len(extra) / len(a) if a else 0.0
    if not extra:
        level = "无"
    elif ratio < 0.3 or len(extra) <= 3:
        level = "低"
    else:
        level = "中" if len(extra) <= 6 else "高"
    return level, extra, ratio
