"""A plain-Python matcher for small cases, written from the rules; used only in tests."""

from __future__ import annotations

import re

NOISE = re.compile(r"[()（）\[\]【】{}/\-\s_]+")


def norm(s):
    if s is None:
        return None
    n = NOISE.sub("", s.strip("".join(map(chr, range(33)))).lower())
    return n or None


def norm_code(s):
    if s is None:
        return None
    return re.sub(r"[\s\-_/]+", "", s.strip()) or None


def grams(s):
    return {s[i:i + 2] for i in range(max(len(s) - 1, 1))}


def sim(a, b):
    a, b = a.strip().lower(), b.strip().lower()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def edit_sim(a, b):
    a, b = a.strip().lower(), b.strip().lower()
    if not a or not b:
        return 0.0
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        before = now
    return 1.0 - before[-1] / max(len(a), len(b))


def cosine_sim(a, b):
    a, b = a.strip().lower(), b.strip().lower()
    if not a or not b:
        return 0.0
    x, y = grams(a), grams(b)
    return 1.0 if a == b else len(x & y) / (len(x) * len(y)) ** 0.5


def match(row, cats, sim=sim):
    """``row``: name, code, extras, material; ``cats``: id, code, name, parent, level.  No synonyms."""
    name, code_n = norm(row["name"]), norm_code(row["code"])
    below = {}
    for c in cats:
        if c["level"] != 3:
            kids, todo = [], [c["id"]]
            while todo:
                at = todo.pop()
                for k in cats:
                    if k["parent"] == at:
                        (kids if k["level"] == 3 else todo).append(k["id"])
            below[c["id"]] = kids or [k["id"] for k in cats if k["level"] == 3 and k["code"].startswith(c["code"])]
    boost = {}
    for c in cats:
        if c["level"] == 3:
            continue
        cn, s = norm(c["name"]), 0.0
        if cn and name:
            if cn == name:
                s = 1.0
            elif cn in name or name in cn:
                s = 0.8
            elif sim(name, cn) >= 0.7:
                s = 0.6 + 0.3 * sim(name, cn)
        if code_n:
            s = max(s, 1.0 if code_n == c["code"] else 0.7 if c["code"].startswith(code_n) else 0.0)
        if s >= 0.7:
            for k in below[c["id"]]:
                boost[k] = max(boost.get(k, 0.0), s * 0.2)
    ranked = []
    for c in cats:
        if c["level"] != 3:
            continue
        cn, score, source = norm(c["name"]), 0.0, None

        def offer(text, eq, inside, floor, label):
            nonlocal score, source
            if not text or not cn:
                return
            s = sim(text, cn)
            got = eq[0] if text == cn else inside[0] if text in cn or cn in text else 0.6 + 0.3 * s if s >= floor else 0.0
            tag = label or (eq[1] if text == cn else inside[1] if text in cn or cn in text else "SEMANTIC")
            if got > score:
                score, source = got, tag

        offer(name, (1.0, "NAME_EXACT"), (0.85, "NAME_FUZZY"), 0.7, None)
        for e in row["extras"]:
            offer(norm(e), (0.9, ""), (0.8, ""), 0.55, "EXTRA_NAME")
        offer(norm(row["material"]), (0.9, ""), (0.8, ""), 0.55, "MATERIAL_NAME")
        rank = score + 0.5
        if not score:
            if row["code"] is not None and row["code"] == c["code"]:
                score, source = 1.0, "CODE_EXACT"
            elif code_n and c["code"].startswith(code_n):
                score, source = 0.6, "CODE_PREFIX"
            else:
                continue
            rank = score
        conf = score
        if c["id"] in boost:
            rank += boost[c["id"]]
            conf = min(1.0, score + boost[c["id"]])
        near = 0.0
        for text in (name, row["material"]):
            if text and text.strip() and cn:
                near = max(near, 1.0 if cn == text else 0.85 if cn in text or text in cn else sim(text, cn))
        ranked.append((-rank, -near, code_n != c["code"], c["code"], c["id"], source, conf))
    if not ranked:
        return None, "UNMATCHED", 0.0
    ranked.sort()
    best = ranked[0]
    ties = sum(r[0] == best[0] for r in ranked)
    source, conf = best[5], best[6]
    if ties > 1 and source in ("NAME_FUZZY", "EXTRA_NAME", "SEMANTIC", "MATERIAL_NAME"):
        source, conf = "FUZZY_AMBIGUOUS", min(conf, 0.5)
    return best[4], source, conf
