"""The rules for Han texts over documents against a plain version, rule by rule."""

import re
from collections import Counter

from siftloom.operators import scoring
from siftloom.plans import given

WHITE = re.compile("[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+")
P, HAN = scoring.HAN_PATTERNS, re.compile("[\\u4E00-\\u9FFF\\u3400-\\u4DBF]")


def units(text):
    return len(text.encode("utf-16-le")) // 2


def share(text):
    bare = WHITE.sub("", text)
    return len(HAN.findall(bare)) / units(bare) if bare else 0.0


def found(vocabulary, text):
    out = []
    for e in vocabulary.entries:
        own = text.lower()
        for phrase in e.not_:
            own = own.replace(phrase.lower(), " " * len(phrase))
        if any(re.search(f"(?<![a-z0-9&]){re.escape(n)}(?![a-z0-9])", own) if n.isascii() else n in own for n in e.needles()):
            out.append(e)
    return out


def count(needles, text):
    return sum(n.lower() in text.lower() for n in needles)


def has(name, text):
    return re.search(P[name], text) is not None


def score(title, excerpt, tail, thread, views, comments):
    body, end = f"{title}\n{excerpt}", f"{excerpt}\n{tail}"
    known = [found(v, body) for v in (given.AGENTS, given.TALK)]
    in_title = sum(e.score for v in (given.AGENTS, given.TALK) for e in found(v, title))
    anywhere, soft = sum(e.score for some in known for e in some), count(scoring.HAN_SOFT, body)
    tags = [",".join(e.id for e in some) for some in known]
    if share(title) < 0.15 and share(body) < 0.15:
        return 0, "language", tags
    if has("job_title", title) or (has("job_role", title) and has("job_pay", title)) or sum(bool(re.search(p, end)) for p in scoring.HAN_JOB_HEADINGS) >= 2:
        return 0, "job", tags
    if has("hard_promo", title):
        return 0, "promo", tags
    if not anywhere + soft:
        return 0, "no-hit", tags
    total = 6 + min(in_title - 1, 2) if in_title else min(anywhere, 2)
    total += min(soft, 2) + 4 * has("first_person", title) + 3 * (count(scoring.HAN_EXPERIENCE, title) > 0)
    lived = count(scoring.HAN_EXPERIENCE, excerpt)
    total += min(lived, 3) - 3 * has("question", title) - 4 * count(scoring.HAN_PROMO, body) - 2 * count(scoring.HAN_NEWS, body) - 2 * count(scoring.HAN_ACADEMIC, body)
    if has("self_promo", f"{title}\n{excerpt[:400]}"):
        total -= 6
    elif has("self_promo", tail or excerpt[-400:]):
        total -= 3
    total -= 6 * has("coach_promo", body) + 6 * (has("machine_report", body) or has("machine_report", tail)) + 8 * (sum(bool(re.search(p, end)) for p in scoring.HAN_LISTICLE_HEADINGS) >= 2)
    if has("serial_title", title):
        total -= 2 if lived >= 4 else 4
    if thread:
        total += -3 if units(excerpt) < 600 else 1 if units(excerpt) >= 1800 else 0
    return total + (views >= 2000 or comments >= 15), None, tags


def test_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in given.han_items(spark, sf).collect():
        total, closed, tags = score(r["title"], r["excerpt"], r["tail"], r["thread"], r["views"], r["comments"])
        want[r["id"]] = (total, "shortlist" if closed is None and total >= 6 else "reject", closed, *tags)
    got = {r["id"]: (r["score"], r["verdict"], r["closed"], r["tools"], r["topics"]) for r in given.han_score_rules(spark, sf).collect()}
    assert got == want
    seen = Counter(v[2] or v[1] for v in want.values())
    assert set(seen) >= {"job", "promo", "no-hit", "shortlist", "reject"} and len({v[0] for v in want.values()}) > 8
