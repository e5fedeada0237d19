import random
import re
from collections import Counter

import pytest

from motes.llm import license_scan as ls
from motes.llm import personal_data as pii
from motes.llm import url_filter as uf
from tests.llm.helpers import awkward, nothing


def test_urls(spark, tmp_path):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "", "allow"), ("a.example.org", "/", "block"), ("com", "/ü", "block")]
    urls = [
        "http://x.example.org/es/1?q", "https://EXAMPLE.org", "ftp://a.example.org/es/", "http://badexample.org/es/", "http://org/a", "x", None, "",
        "http://b.com/übung#x", "http://b.com/u", "http:///es/", "a\n://c.org/\n?", "http://example.org/es", "http://.org/",
    ]

    def brute(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best and best[1], best[2] if best else "block" if not host else "allow"

    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for per_file in (uf.RULES_PER_FILE, 2):
        got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.url_filter(pages, table, per_file=per_file).collect()}
        assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert uf.url_filter(pages.limit(0), table).count() == 0
    assert uf.url_filter(pages, table.limit(0)).filter("rule IS NOT NULL").count() == 0


def test_very_long_hosts(tmp_path):
    rules = [("b.a", "/x", "block"), ("a", "/", "allow"), ("long.host.of.a.rule", "/", "block")]
    (tmp_path / "i").write_bytes(uf.pack(rules))
    index = uf.Index(str(tmp_path / "i"))
    hosts = ["c." * 100_000 + "b.a", "c" * 300_000, "." * 200_000, "x.long.host.of.a.rule", "long.host.of.a.rule", "xlong.host.of.a.rule"]
    got = index.longest(hosts, ["/x"] * len(hosts))
    assert got == [("b.a/x", "block"), None, None, *[("long.host.of.a.rule/", "block")] * 2, None]


def test_url_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(uf.xxhash, "xxh64_intdigest", lambda b: len(b) % 3)
    (tmp_path / "x").write_bytes(uf.pack([("a", "/", "block"), ("bb", "/", "allow"), ("cccc", "/", "block"), ("dddd", "/", "allow")]))
    found = uf.Index(str(tmp_path / "x")).longest(["a", "cccc", "dddd", "eeee"], ["/"] * 4)
    assert found == [("a/", "block"), ("cccc/", "block"), ("dddd/", "allow"), None]


def test_licences(spark):
    texts = [
        "Released under the MIT License. General Public License; the Apache  license, mit license",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "We talk of a license and of public things in general.",
        "Licensed under CC BY-NC 4.0.", None, "", "mitlicense É MIT\nLICENSE",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.row.doc_id: r for r in ls.license_scan(df).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        at = sorted((j, label) for p, label in ls.PHRASES.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split())
        assert (got[i].n_words, got[i].n_base) == (len(words), len(at))
        assert (got[i].first_word, got[i].last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert got[i].base_labels == ",".join(sorted({x[1] for x in at}))
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))
        assert 0 <= got[i].score <= 1
    assert got[1].labels == "mit" and got[3].labels == "cc-by-nc" and got[2].labels == "" and got[2].score == 0
    assert ls.license_scan(awkward(spark)).count() == 10
    assert ls.license_scan(nothing(spark)).count() == 0


@pytest.mark.parametrize("every", [3, 1])
def test_frequent_notices(spark, every):
    # the words of the notices are in a third of all rows, or in all
    notices = {" ".join(t.split()): label for label, t, _ in ls.TEMPLATES}
    for notice, label in [("Licensed under CC BY-NC 4.0.", "cc-by-nc"), *((n, notices[n]) for n in notices if "license" not in n)]:
        rows = [(i, f"text {i} begins here {notice if i % every == 0 else 'and no more'} and ends {i}") for i in range(600)]
        texts = [t.encode() for _, t in rows]
        words = {w for _, t, _ in ls.TEMPLATES for w in t.encode().split()}
        frequency = Counter(w for t in texts for w in words.intersection(ls.file_words(t)))
        scanner = ls.Scanner(frequency, len(texts))
        found = [scanner.scan(t) for t in texts]
        assert [f[5] for f in found] == [label if i % every == 0 else "" for i, _ in rows]
        assert all(f[6] > 0.99 for f in found[::every])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ls.license_scan(df).filter("labels <> ''").count() == len(rows[::every])


def test_every_place_with_the_share_is_found():
    """The index loses nothing against the comparison of every place, at any frequencies."""
    rng = random.Random(5)
    for _ in range(40):
        words = sorted({w for _, t, _ in ls.TEMPLATES for w in t.encode().split()})
        n = rng.choice([1, 30, 1000, 10**6])
        frequency = {w: rng.choice([0, 1, n // 30, n // 3, n]) for w in words}
        scanner, everything = ls.Scanner(frequency, n), ls.Scanner(frequency, n)
        for i, (_, body, _) in enumerate(everything.templates):
            for q, w in enumerate(body):
                if (i, q) not in everything.postings[w]:
                    everything.postings[w].append((i, q))
        everything.agree, everything.indexed = [1] * len(everything.templates), set(words)
        for _ in range(20):
            text = b" ".join(b" ".join(w for w in rng.choice(scanner.templates)[1] if rng.random() > 0.15) for _ in range(3))
            assert scanner.scan(text) == everything.scan(text)


def test_base_spans():
    cases = {
        "a.b+c@host.example.com.": [(0, 22, "email")],
        "x@y no, x@y.z@q.r": [(8, 13, "email")],
        "1.2.3.4.5.6.7.8": [(0, 7, "ip"), (8, 15, "ip")],
        "256.1.1.1 0255.1.1.1": [(10, 20, "ip")],
        "4111 1111-1111 1111": [(0, 19, "card")],
        "4111 1111-1111 1112": [],
        "+1 (988) 555-2485 x": [(0, 17, "phone")],
        "+1 12": [],
        "٣٣٣.1.1.1": [],
    }
    for text, spans in cases.items():
        assert pii.base_spans(text) == spans, text


def test_addresses_as_the_pattern_finds_them():
    import random

    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("ab.@-é 1") for _ in range(rng.randint(0, 24)))
        assert pii.addresses(text) == [(m.start(), m.end(), "email") for m in pii.EMAIL.finditer(text)], text
    assert pii.addresses("a" * 300_000 + " x@y.z") == [(300_001, 300_006, "email")]


def test_semi_markov_best_and_gradient():
    import itertools

    import numpy as np

    random = np.random.default_rng(1)
    w = random.normal(size=(4, len(pii.FEATURES)))
    text = "to 12.34.56.78 or a@b.c +12 3456789012"
    borders, spans = pii.candidates(text)
    chosen = pii.best_segments(text, w)
    scored = [(i, j, k, float(w[k] @ x)) for i, j, k, x in spans]
    best = 0.0
    for n in (1, 2, 3):  # every division into at most three entities
        for some in itertools.combinations([s for s in scored if s[3] > 0], n):
            some = sorted(some)
            if all(a[1] <= b[0] for a, b in zip(some, some[1:])):
                best = max(best, sum(s[3] for s in some))
    assert len(chosen) <= 3 and sum(c[3] for c in chosen) == pytest.approx(best)

    examples = [("call +1 (988) 555-2485 now", [(5, 22, "phone")]), ("at 12.34.56.78, ok", [(3, 14, "ip")]), ("a.b@host.example.com", [(0, 20, "email")]), ("n 4041894974608795 x", [(2, 18, "card")]), ('k="0641917ea4e9feb9cda8"', [])]
    trained = pii.train(examples * 40)
    for text, gold in examples:
        assert [(s, e, pii.KINDS[k]) for s, e, k, _ in pii.best_segments(text, trained)] == gold


def test_personal_data_rows(spark):
    df = awkward(spark)
    got = pii.personal_data(df).collect()
    assert len(got) == df.count()
    hit = next(r for r in got if r.row.doc_id == 7)
    assert (hit.n_email, hit.n_phone) == (1, 1) and hit.base == "email:5:25,phone:29:46"
    clean = pii.redacted(df)
    assert clean.columns == df.columns
    assert next(r for r in clean.collect() if r.doc_id == 7).text == "mail <EMAIL> or <PHONE>, MIT License"
    assert pii.redacted(nothing(spark)).count() == 0


def test_redaction_is_one_python_pass(spark):
    texts = ["mail a.b@host.example.com or +1 (988) 555-2485", "4111 1111 1111 1111 and 10.0.0.255", "+1 4111 1111 1111 1111", "é 1.2.3.4", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.redacted(df)
    # each pass of a task holds a Python worker of its own
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    spans = {r["row"].doc_id: r["spans"] for r in pii.personal_data(df).collect()}
    for r in out.collect():
        want, at, t = "", 0, texts[r.doc_id]
        for kind, s, e in (x.split(":") for x in spans[r.doc_id].split(",") if x):
            want += t[at : int(s)] + f"<{kind.upper()}>" if int(s) >= at else ""
            at = max(at, int(e))
        assert r.text == (t and want + t[at:])
