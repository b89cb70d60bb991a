import hashlib
import math
import random
import re
import unicodedata

from pyspark.sql import functions as F

from delayrisk.llm import pii
from delayrisk.llm.queries import op3_pii_disclosure

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                    "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]():
                out.append((m.start(), k, m.end(), m[0]))
    return sorted(out)


HARD = ["a@b.c_d@e.f", "x@y", "@a.b", "a@b..c", "a@b.c.d.", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 1.1.1.00001", "1.2.3",
        "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "4111111111111112", "99999999999999999999", "0" * 16,
        "+1 (212) 555-0100 +12 +", "+1..........", "++44 20 7946 0958", "é+44 20 7946 0958😀a@b.co", "+123456789012345678",
        "a" * 30_000, "1" * 30_000, "1." * 20_000, "1 " * 20_000, "+" * 20_000, "a@" * 10_000, "a@b.c " * 300, "%" * 9_000 + "@x.y"]


def test_base_spans_match_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.s] for r in docs.select("doc_id", pii.base_spans(F.col("text")).alias("s")).collect()}
    for k, t in enumerate(HARD):
        assert got[k] == brute(t), t[:60]


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_pii_disclosure(spark, sf).collect()
    assert len(got) == len(texts)
    kinds = list(PATTERNS)
    for r in got:
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in want) for k in range(4)]
        listed = ",".join(f"{kinds[s[1]]}:{s[0]}:{s[2]}" for s in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_terms_that_disclose(spark):
    """A rare name beside an address goes; a word that is everywhere, or seen beside it once, stays."""
    rows = [(k, f"please write to Quillon at q.q@mail.org today {k}") for k in range(3)]
    rows += [(10 + k, "please write to them at home today " * 40) for k in range(20)] + [(40, "once Zephyrine wrote from z@mail.org today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.i: {s.value for s in r.terms} for r in pii.spans(docs).collect()}
    assert all(got[k] == {"quillon"} for k in range(3)) and not got[40] and not got[10]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "please write to  at [EMAIL] today 0" and clean[10] == rows[3][1]


def word_like(c):
    return unicodedata.category(c)[0] in "LMN"


def brute_terms(text):
    """(start, end, term) of the terms of a text, character by character."""
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and word_like(text[end]):
            end += 1
        if end > at:
            before, after, more = text[at - 1:at], text[end:end + 1], text[end + 1:end + 2]
            joined = before and before in "._%+@-" or after and after in "_%+@-" or after == "." and more and unicodedata.category(more)[0] in "LN"
            lettered = next((unicodedata.category(c)[0] for c in text[at:end] if unicodedata.category(c)[0] != "N"), "N") == "L"
            if end - at > 1 and lettered and not joined:
                out.append((at, end, text[at:end].lower()))
        at = max(end, at + 1)
    return out


def brute_disclosed(texts, threshold=0.9, min_together=2):
    """Per text the places of its disclosing terms, from all pairs of entity and term."""
    texts = set(texts)
    entities, terms = {}, {}
    for t in texts:
        for s in brute(t):
            entities.setdefault((s[1], s[3]), set()).add(t)
        for _, _, w in brute_terms(t):
            terms.setdefault(w, set()).add(t)
    reveal, d = {t: set() for t in texts}, len(texts)
    for e in entities.values():
        for w, held in terms.items():
            both = len(e & held)
            if both >= min_together and len(e) < d and math.log(both * d / (len(held) * len(e))) / math.log(d / len(e)) >= threshold:
                for t in e & held:
                    reveal[t].add(w)
    return {t: [(a, b, w) for a, b, w in brute_terms(t) if w in reveal[t]] for t in texts}


def test_terms_match_brute_force(spark):
    """Names far from the address, of two letters, in other scripts or with digits; copies count once."""
    rng = random.Random(5)
    names = ["Bo", "李明", "user77", "Zoë", "Kim-Lee", "कमल", "X", "2024", "Nadia"]
    mails = [f"m{k}@box{k % 3}.org" for k in range(7)] + ["+44 20 7946 0958"]
    texts = []
    for _ in range(90):
        body = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(5, 60))]
        for k in rng.sample(range(8), rng.choice([0, 0, 1, 1, 2])):
            body.insert(rng.randrange(len(body)), mails[k])
            body[rng.randrange(len(body))] += f" {names[k]}. " + names[k + 1] * (rng.random() < 0.04)
        texts.append(" ".join(body))
    texts += texts[:30] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_disclosed(texts)
    assert {w for found in want.values() for _, _, w in found} >= {"bo", "李明", "user77", "zoë"}
    got = pii.spans(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [(s.start, s.end, s.value) for s in r.terms] == want[texts[r.i]]
        assert [tuple(s) for s in r.base] == brute(texts[r.i])


def plain_clean(text, marks):
    out, at = [], 0
    for start, kind, end in sorted(marks):
        if start >= at:
            out.append(text[at:start] + ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "")[kind])
        at = max(at, end)
    return "".join(out) + text[at:]


def test_long_lists_of_addresses(spark):
    """Two near copies of a list of 20,000 addresses: every place right, no pair per address and word."""
    text = " ".join(f"né{k} u{k}@mail.org" for k in range(20_000))
    texts = [text, text + " tail", "other words", "more of them here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    want = brute_disclosed([t[:t.index(" né50 ")] if "né" in t else t for t in texts])
    assert all(w.startswith("né") for found in want.values() for _, _, w in found)
    for k in (0, 1):
        terms = [(a, 4, b) for a, b, w in brute_terms(texts[k]) if w.startswith("né")]
        assert got[k] == plain_clean(texts[k], [s[:3] for s in brute(texts[k])] + terms)
    assert got[2] == texts[2] and got[3] == texts[3]


def test_sanitise_spans_that_overlap(spark):
    docs = spark.createDataFrame([(1, "call +44 20 7946 0958 or 1.2.3.4 a@1.2.3.4 end")], "doc_id long, text string")
    assert pii.sanitise(docs).first().text == "call [PHONE] or [IP] [EMAIL] end"


def test_odd_rows(odd):
    got = pii.spans(odd).collect()
    assert len(got) == odd.count()
    assert sum(len(r.base) for r in got) == 2
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert {r.text for r in clean.collect()} >= {None, "", "mail [EMAIL] or [PHONE] now"}


def test_empty(empty):
    assert pii.spans(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_runs_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (pii.spans(docs), pii.sanitise(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
