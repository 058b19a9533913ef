import hashlib
import random
import re

from playstat.llm.pii import KINDS, bootstrap, emails, extract, ips, cards, find, joined, luhn, op4_pii, phones, redact
from tests.llm.conftest import SF, odd_texts

FORMS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    keep = (lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")),
            lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)), lambda s: 8 <= len(digits(s)) <= 15)
    return [(k, m.start(), m.end()) for k, f, ok in zip(KINDS, FORMS, keep)
            for m in re.finditer(f, text or "") if ok(m.group())]


def test_rules_equal_plain_patterns():
    r = random.Random(2)
    parts = list("0123456789..@@-+() aé") + ["a.b", "@x.y", "1.2.3.4", " 4041894974608795", "256", "+1 555"]
    for _ in range(8000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 40)))
        want = base(t)
        got = [(k, a, b) for k, f in zip(KINDS, (emails, ips, cards, phones)) for a, b in f(t)]
        assert got == want, t


def test_query_base_spans_equal_plain_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(SF + "/documents.parquet").collect()}
    for r in op4_pii(spark, SF).collect():
        want = base(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in KINDS]
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_odd_rows(odd, none):
    rows = extract(odd).collect()
    assert len(rows) == len(odd_texts())
    want = {i: base(t) for i, t in odd_texts() if i != 18}
    for r in rows:
        if r.doc_id in want and r.doc_id is not None:
            assert [tuple(s) for s in r.base_spans] == want[r.doc_id]
    assert extract(none).count() == 0 and redact(none).count() == 0
    assert redact(odd).columns == odd.columns


def contexts(spark):
    rows = [(i, f"é Please call me at +1 555 {1000 + i * 37 % 9000} today or mail: u{i}@x{i % 7}.example.com thanks")
            for i in range(30)]
    rows += [(100, "Please call me at 555-123-4567 today ok"), (101, "nothing at all 12345678 here"),
             (104, "mail: bob@localhost thanks"), (106, "call me at deadbeef0123 now")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_trusted_contexts_find_unseen_identifiers(spark):
    docs = contexts(spark)
    found = {r.doc_id: r.s for r in extract(docs).withColumn("s", joined("spans")).collect()}
    assert found[100] == "phone:18:30" and found[104] == "email:6:19"
    assert found[101] == found[106] == ""
    text = {r.doc_id: r.text for r in redact(docs).collect()}
    assert text[100] == "Please call me at <phone> today ok" and text[106] == "call me at deadbeef0123 now"
    assert text[0] == "é Please call me at <phone> today or mail: <email> thanks"


def test_copies_do_not_make_a_pattern_trusted(spark):
    docs = spark.createDataFrame([(i, "ring +1 555 1234567 now") for i in range(50)] + [(99, "ring 555-12-4567 now")],
                                 "doc_id long, text string")
    assert bootstrap(find(docs.withColumnRenamed("doc_id", "pii_key"), ["pii_key"])) is None


def test_labels_spread_until_no_round_finds_more(spark):
    n, values = 5, [f"555-123-{4000 + k}" for k in range(1, 6)]
    rows = []
    for k in range(n):
        old = [f"+1 555 {1000 + 10 * k + j}" for j in range(5 - (k > 0))]
        name = "abcde"[k] * 3
        rows += [f"word {name} {v} then {j}" for j, v in enumerate(old + values[max(0, k - 1):k + 1])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    text = " ".join(r.text for r in redact(docs).collect())
    assert not any(v in text for v in values)


def test_many_unseen_values_do_not_spoil_a_pattern(spark):
    rows = [f"dial {v} please" for v in [f"+1 555 {1000 + k}" for k in range(6)] + [f"555-123-{4000 + k}" for k in range(40)]]
    # mostly values of no phone's form, or of another kind
    rows += [f"order {v} please" for v in [f"+1 556 {1000 + k}" for k in range(6)] + [f"x{4000 + k}" for k in range(3)] + ["5551239999"]]
    rows += [f"host {v} please" for v in [f"+1 557 {1000 + k}" for k in range(6)] + [f"1.2.3.{k}" for k in range(3)] + ["5551238888"]]
    docs = spark.createDataFrame(list(enumerate(f"lorem {t.split()[0]} {t}" for t in rows)), "doc_id long, text string")
    text = " ".join(r.text for r in redact(docs).collect())
    assert "555-123-4" not in text and "5551239999" in text and "5551238888" in text


def test_long_values_with_an_equal_start_differ():
    from playstat.llm.pii import occurrences
    one, two = "1" * 200 + "@localhost", "1" * 200 + "x" * 15
    values = [o[3] for t in (one, two, one.upper()) for part in occurrences(t) for o in part]
    assert len(values) == 3 and values[0] != values[1] and values[0] == values[2]


def plain_occurrences(text):
    """(kind or None, start, end, value, patterns), neighbours found by looking at all words."""
    from playstat.llm.pii import _TRIM
    spans = base(text)
    found = list(spans)
    tokens = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    for a, b in tokens:
        while a < b and text[a] in _TRIM:
            a += 1
        while a < b and text[b - 1] in _TRIM:
            b -= 1
        word = text[a:b]
        if word and ("@" in word or len(re.findall("[0-9]", word)) >= 4) and not any(x < b and y > a for _, x, y in spans):
            found.append((None, a, b))
    edges = {p for _, a, b in found for p in (a, b)}
    words = []
    for a, b in tokens:
        cuts = [a, *sorted(p for p in edges if a < p < b), b]
        words += zip(cuts, cuts[1:])
    short = lambda w: hashlib.sha256(w.encode()).hexdigest() if len(w) > 64 else w
    clean = lambda s: short(re.sub("[0-9]+", "0", text[s[0]:s[1]].strip(_TRIM)).lower())
    rows = []
    for kind, a, b in found:
        before = ["^", "^", *(clean(w) for w in words if w[1] <= a)]
        after = [clean(w) for w in words if w[0] >= b] + ["$"]
        rows.append((kind, a, b, short(text[a:b].lower()),
                     (f"{before[-2]} {before[-1]} _", f"{before[-1]} _ {after[0]}")))
    return rows


def plain_bootstrap(texts):
    """All spans of each text, labels spread over dicts until a round adds none."""
    from playstat.llm.pii import fits
    rows = [(t, *o) for t in set(texts) for o in plain_occurrences(t)]
    kinds, added = {}, {}
    for _, kind, _, _, value, _ in rows:
        if kind:
            kinds.setdefault(value, set()).add(kind)
    while True:
        by_pattern = {}
        for t, _, a, b, value, patterns in rows:
            for p in patterns:
                by_pattern.setdefault(p, {})[value] = fits(t[a:b])
        trusted = {}
        for p, values in by_pattern.items():
            for k in KINDS:
                n = sum(k in kinds.get(v, ()) for v in values)
                against = sum(k not in kinds.get(v, ()) and (v in kinds or k not in f) for v, f in values.items())
                if n >= 5 and n >= 0.8 * (n + against):
                    trusted[p, k] = n / (n + against)
        best = {}
        for t, _, a, b, value, patterns in rows:
            if value not in kinds:
                for k in fits(t[a:b]):
                    miss = 1.0
                    for p in patterns:
                        miss *= 1 - min(0.999, trusted.get((p, k), 0))
                    if 1 - miss >= 0.8 - 1e-9:
                        best[value] = max(best.get(value, (0, "")), (1 - miss, k))
        if not best:
            break
        for value, (_, k) in best.items():
            kinds[value], added[value] = {k}, k
    return {t: sorted(((kind or added[v], a, b) for kind, a, b, v, _ in plain_occurrences(t) if kind or v in added),
                      key=lambda s: (KINDS.index(s[0]), *s[1:])) for t in set(texts)}


def test_spans_equal_a_plain_bootstrap(spark):
    r = random.Random(9)
    leads = ["call me at", "phone:", "mail to", "write", "host", "x" * 50, "y" * 90, "order no", "see", ""]
    made = [lambda: f"+1 555 {r.randrange(1000, 1400)}", lambda: f"555-123-{r.randrange(4000, 4040)}",
            lambda: f"u{r.randrange(40)}@x.example.com", lambda: f"bob{r.randrange(30)}@localhost",
            lambda: f"10.0.0.{r.randrange(200)}", lambda: f"10.0.0.{r.randrange(200)}.7", lambda: f"fe80::{r.randrange(1000, 1030)}:1",
            lambda: str(r.randrange(10 ** 6, 10 ** 6 + 30)), lambda: "9" * 70 + "@" + "a" * r.randrange(1, 9)]
    likely = {0: (0, 1), 1: (0, 0, 1), 2: (2, 3), 3: (2, 3, 3), 4: (4, 5, 6), 5: (0, 1), 6: (2, 3, 8), 7: (7, 7, 0)}
    texts = []
    for _ in range(700):
        words = []
        for _ in range(r.randint(1, 4)):
            lead = r.randrange(len(leads))
            pick = r.choice(likely[lead]) if lead in likely and r.random() < 0.9 else r.randrange(len(made))
            words += [leads[lead], made[pick]() + r.choice(["", "", ",", ")", ";a"]), r.choice(["now", "today", "", "\n"])]
        texts.append(r.choice(["", "é ", "the "]) + " ".join(words))
    texts += texts[:50]
    want = plain_bootstrap(texts)
    assert sum(len(s) for s in want.values()) > sum(len(base(t)) for t in want) + 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for row in extract(docs).collect():
        assert [tuple(s) for s in row.spans] == want[texts[row.doc_id]], texts[row.doc_id]


def test_a_long_text_of_one_word_is_read_once():
    import time

    from playstat.llm.pii import occurrences
    text, start = "a@b.cc,;" * 100_000, time.time()
    assert len(occurrences(text)[0]) == 100_000 and time.time() - start < 10


def test_helper_columns_of_redact_do_not_clash(spark):
    docs = contexts(spark).selectExpr("doc_id", "text", "'mine' _pii_extra", "1 _PII_KEY")
    rows = redact(docs).collect()
    assert redact(docs).columns == docs.columns and {(r._pii_extra, r._PII_KEY) for r in rows} == {("mine", 1)}
    assert {r.text for r in rows} == {r.text for r in redact(contexts(spark)).collect()}
