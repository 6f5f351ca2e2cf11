"""Operators that SQL can't express: brute force, round trips and held-out accuracy."""

import base64
import datetime
import hashlib
import re
from itertools import pairwise

import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from tests.compare import DATA
from tidescope.llm import common, decontaminate, license_scan, pii, queries, sentencepiece_codec, toxicity, warc
from tidescope.llm.common import TOKENIZER, components, cut, documents

SF, LARGER, LARGEST = str(DATA / "sf0.001"), str(DATA / "sf0.01"), str(DATA / "sf0.1")
MODEL = TOKENIZER


# --- decontamination ------------------------------------------------------------------------------------------------------


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_leaks_are_those_of_brute_force(spark):
    docs, bench = documents(spark, LARGER), spark.read.parquet(f"{LARGER}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]): r["lcs"] for r in decontaminate.leaks(docs, bench).collect()}
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    # every passage that a document holds word for word is found
    parts = [(i, b" ".join(p)) for item in items for i, p, _ in decontaminate.passages([(*item, None)])]
    verbatim = {(d, i) for d, t in texts.items() for raw in [b" %s " % b" ".join(decontaminate.words_of(t))] for i, p in parts if b" %s " % p in raw}
    assert verbatim and verbatim <= set(found)
    # and nothing is found that does not hold its share of a passage in order
    by_item = {i: [p for j, p, _ in decontaminate.passages([(*item, None) for item in items if item[0] == i]) if j == i] for _, i in found}
    for (d, i), share in found.items():
        words = decontaminate.words_of(texts[d])
        assert share >= 0.6 and max(longest(p, words) / len(p) for p in by_item[i]) >= share - 1e-9


def test_paraphrases_need_their_answer(spark):
    item = "which river runs past the old mill near the northern town before it meets the sea . it is the silver river of the north"
    edited = item.replace("old", "ancient").replace("northern", "upper").replace("before", "until")
    bench = spark.createDataFrame([(1, item, "silver river")], "item_id long, text string, answer string")
    rows = [(1, f"some words first {edited} and some after"), (2, "a clean document about nothing of the kind " * 5), (3, item.upper())]
    rows += [(i, f"other{i} words{i} fill{i} the{i} corpus{i} " * 4) for i in range(4, 60)]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 3]


def test_blocks_split_the_query_set_alone(spark):
    docs, bench = documents(spark, SF), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    split = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench, block_words=600).collect()}
    assert {d for d, _ in whole} == {d for d, _ in split}


def test_decontamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "one two three four five six seven eight nine ten"), (4, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert decontaminate.leaks(odd, bench).count() == 0
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0


# --- licences ---------------------------------------------------------------------------------------------------------------


def plain_windows(own, templates, threshold=0.8):
    """Of the windows as long as a template that begin with a bigram of it, each that no better one overlaps (nor an equal one before it)."""
    for i, (name, text) in enumerate(templates):
        held = set(pairwise(license_scan.words(text)))
        length = len(license_scan.words(text)) - 1
        found = {}
        for s in range(len(own) - 1):
            if (own[s], own[s + 1]) in held:
                grams = set(pairwise(own[s : s + length + 1]))
                v = 2 * len(grams & held) / (len(grams) + len(held))
                if v >= threshold:
                    found[s] = v
        for s, v in found.items():
            if all((found[o], -o) < (v, -s) for o in found if o != s and abs(o - s) < length):
                yield "window", hashlib.sha256(b" ".join(own[s : s + length + 1])).hexdigest(), name, i, round(v, 6)


def test_licences_inside_lines_and_whole_texts_are_found(spark):
    name, text = license_scan.TEMPLATES[14]
    notice = license_scan.TEMPLATES[1][1]
    pre = " ".join(f"p{i}" for i in range(70))
    rows = [(1, f"{pre} {notice} {pre}"), (2, f"{pre}\n{text.upper()}\n\n{pre}"), (3, f"{pre} {text.replace('NO EVENT', 'NO CASE')} {pre}"), (4, pre), (5, f"{notice} {notice}")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["kind"], r["unit_sha256"], r["license_id"], r["template"], round(r["dice"], 6)) for r in license_scan.scan(table).collect()}
    windows = {(d, *w) for d, t in rows for w in plain_windows(license_scan.words(t), license_scan.TEMPLATES)}
    assert {f for f in found if f[1] == "window"} == windows
    assert {(d, n) for d, k, _, n, *_ in found if k == "window"} >= {(1, "Apache-2.0"), (2, name), (3, name), (5, "Apache-2.0")} and not any(f[0] == 4 for f in found)
    own = license_scan.templates(spark.createDataFrame([("X", "alpha beta gamma delta epsilon"), ("Y", None), ("Z", "one")], "license_id string, text string"))
    assert own == (("X", "alpha beta gamma delta epsilon"),)
    assert {r["kind"] for r in license_scan.scan(spark.createDataFrame([(1, "so alpha beta gamma delta epsilon it is")], "doc_id long, text string"), rows=own).collect()} == {"window"}


def test_licences_equal_brute_force(spark, odd, none):
    def dice(a, b):
        a, b = set(pairwise(license_scan.words(a))), set(pairwise(license_scan.words(b)))
        return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = set()
    for d, t in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        for kind, unit in license_scan.units(t) if t else ():
            for i, (name, text) in enumerate(license_scan.TEMPLATES):
                if (v := dice(unit, text)) >= 0.8:
                    want.add((d, kind, hashlib.sha256(unit.encode()).hexdigest(), name, i, round(v, 6)))
        want |= {(d, *found) for found in plain_windows(license_scan.words(t or ""), license_scan.TEMPLATES)}
    assert want and {tuple(r) for r in queries.op3_license_scan(spark, SF).collect()} == want
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(none).count() == 0


# --- toxicity --------------------------------------------------------------------------------------------------------------


def auc(rows):
    order = sorted(rows)
    toxic = sum(y for _, y in rows)
    ranks, i = 0.0, 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:
            j += 1
        ranks += sum(y for _, y in order[i:j]) * (i + j + 1) / 2
        i = j
    return (ranks - toxic * (toxic + 1) / 2) / (toxic * (len(rows) - toxic))


def test_held_out_accuracy(spark):
    """At sf0.1: the smaller tables have 31 toxic rows to train on and fewer, too few words stand out in those (held-out area 0.885 at sf0.01)."""
    found = queries.op5_compression_toxicity(spark, LARGEST)
    labels = spark.read.parquet(f"{LARGEST}/labels.parquet").select("doc_id", "toxic")
    rows = found.filter("held_out").join(labels, "doc_id").collect()
    assert auc([(r["score"], r["toxic"]) for r in rows]) >= 0.9
    flagged = [r["toxic"] for r in rows if r["predicted"]]
    assert sum(flagged) / len(flagged) >= 0.9
    assert sum(flagged) / sum(r["toxic"] for r in rows) >= 0.6
    assert all(0 <= r["score"] <= 1 for r in found.collect())


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)  # one class only: no model
    assert {r["score"] for r in toxicity.score(odd, model).collect()} == {0.0}
    few = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'ordinary'} words here {i}") for i in range(60)], "doc_id long, text string")
    model = toxicity.fit(few, few.selectExpr("doc_id", "int(doc_id % 2) AS toxic"))
    assert model.weights and len(model.toxic) > 8
    found = toxicity.score(odd, model)
    assert found.count() == odd.count() and toxicity.score(none, model).count() == 0
    empty = {r["score"] for r in found.filter("doc_id in (3, 4, 5)").collect()}
    assert len(empty) == 1


# --- WARC ----------------------------------------------------------------------------------------------------------------


def test_records_are_linked_and_digested(spark):
    rows = queries.op6_warc_derivatives(spark, SF).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == 3 * len(pages)
    responses = {r["record_id"]: r for r in rows if r["record_type"] == "response"}
    for r in rows:
        raw = r["block"].encode()
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r["headers"]["Content-Length"] == str(len(raw)) and r["target_uri"] == pages[r["page_id"]]["url"]
        if r["record_type"] == "response":
            assert r["block"] == "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + (pages[r["page_id"]]["html"] or "") and r["refers_to"] is None
            payload = (pages[r["page_id"]]["html"] or "").encode()
            assert r["source_digest"] == r["headers"]["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            source = responses[r["refers_to"]]
            assert r["headers"]["WARC-Refers-To"] == source["record_id"] and r["source_digest"] == source["source_digest"]
        if r["record_type"] == "conversion":
            assert "<script" not in r["block"]


def test_a_page_becomes_facts_and_text(spark):
    page = "<html lang='EN'><head><title>A &amp; B</title></head><body><p>One <b>two</b></p><script>no()</script><a href='/x'>three</a><a href=\"/x\">again</a><!-- no --></body></html>"
    table = spark.createDataFrame([(1, "http://h.example/a/", page), (2, None, None), (3, "http://[bad", "<a href='http://[bad'>t</a>"), (4, "", "")], "page_id long, url string, html string")
    rows = warc.records(table.withColumn("block", table.page_id)).collect()
    by = {(r["page_id"], r["record_type"]): r for r in rows}
    assert by[1, "conversion"]["block"] == "One two\nthreeagain"
    assert by[1, "metadata"]["block"] == "title: A & B\r\nlanguage: en\r\noutlink: http://h.example/x\r\n"
    assert by[2, "conversion"]["block"] == "" and "WARC-Target-URI" not in by[2, "response"]["headers"]
    assert warc.serialise({"WARC-Type": "metadata"}, "x") == b"WARC/1.1\r\nWARC-Type: metadata\r\n\r\nx\r\n\r\n"
    given = table.limit(1).selectExpr("page_id", "url", "html", "'2024-05-06T07:08:09Z' AS warc_date", "'<urn:x>' AS record_id", "map('Content-Type', 'text/html; charset=utf-8', 'ETag', 'e') AS http_headers")
    for r in warc.records(given).collect():
        own = r["record_type"] == "response"
        assert (r["date"], r["record_id"] == "<urn:x>", r["refers_to"]) == ("2024-05-06T07:08:09Z", own, None if own else "<urn:x>")
        assert "\r\nETag: e\r\n" in r["block"] if own else r["headers"]["WARC-Source-HTTP-ETag"] == "e"
        assert own or r["headers"]["WARC-Source-Content-Type"] == "text/html; charset=utf-8"
    assert len({r["record_id"] for r in rows}) == 12 and warc.records(table.limit(0)).count() == 0


def test_pages_are_read_as_another_parser_reads_them(spark):
    """Visible text and links against the standard library's parser, over the pages of the test tables."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.text, self.links, self.hidden = [], [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in warc.HIDDEN
            if tag == "a" and dict(attrs).get("href") is not None:
                self.links.append(dict(attrs)["href"])
            if tag in warc.BREAKS:
                self.text.append("\n")

        def handle_endtag(self, tag):
            self.hidden -= tag in warc.HIDDEN and self.hidden > 0
            if tag in warc.BREAKS:
                self.text.append("\n")

        def handle_data(self, data):
            if not self.hidden:
                self.text.append(data)

    same = links = 0
    pages = spark.read.parquet(f"{LARGER}/pages.parquet").filter("html is not null and url is not null").collect()
    for r in pages:
        other = Plain()
        other.feed(r["html"])
        same += "".join(other.text).split() == warc.plain(r["html"]).split()
        found = [line[9:] for line in warc.facts(r["html"], r["url"]).split("\r\n") if line.startswith("outlink: ")]
        links += found == list(dict.fromkeys(urljoin(r["url"], x.strip()) for x in other.links))
    assert same >= 0.99 * len(pages) and links >= 0.99 * len(pages)


def test_long_pages_take_time_in_proportion():
    import time

    for unit in ("<script ", "<a ", "<!--", "<title>", "<a href ", "<script>", "&lt;", "<"):
        began = time.process_time()
        warc.derive(1, "http://h.example/", unit * 100_000)
        assert time.process_time() - began < 20, unit


# --- pseudonyms -------------------------------------------------------------------------------------------------------------


def test_the_permutation_is_one():
    for size in (2, 3, 7, 10, 99, 1000):
        assert sorted(pii.permuted(v, size, b"key", b"t") for v in range(size)) == list(range(size))
    assert [pii.permuted(v, 1000, b"a", b"t") for v in range(50)] != [pii.permuted(v, 1000, b"b", b"t") for v in range(50)]


def test_values_keep_format_and_stay_linked(spark, odd, none):
    card, iban, day = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "2021-02-28"
    text = f"card {card}, iban {iban}, on {day}; bad 4111 1111 1111 1112 and 2021-02-30; ssn 123-45-6789; at 10.0.0.1; call +49 30 1234567"
    table = spark.createDataFrame([(1, text), (2, f"again {card} {day}"), (3, None), (4, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.pseudonymise(table, b"key").collect()}
    assert rows[3]["text"] is None and rows[4]["text"] == ""
    kinds = [s["kind"] for s in rows[1]["spans"]]
    values = {s["kind"]: rows[1]["text"][s["start"] : s["end"]] for s in rows[1]["spans"]}
    assert sorted(kinds) == ["card", "date", "iban", "ip", "phone", "ssn"]
    digits = values["card"].replace(" ", "")
    assert pii.luhn(digits[:-1]) == int(digits[-1]) and values["card"] != card and values["card"].count(" ") == 3
    whole = values["iban"].replace(" ", "")
    assert pii.iban_number(whole[4:] + whole[:4]) % 97 == 1 and values["iban"] != iban
    datetime.date.fromisoformat(values["date"])
    assert "4111 1111 1111 1112" in rows[1]["text"] and "2021-02-30" in rows[1]["text"]
    assert values["card"] in rows[2]["text"] and values["date"] in rows[2]["text"]
    assert pii.pseudonymise(odd, b"key").count() == odd.count() and pii.pseudonymise(none, b"key").count() == 0


def plain_luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_mod97(text):
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def test_values_are_found_next_to_other_numbers_and_words(spark):
    """Values placed among others: each goes, keeps its shape and its validity, and nothing else changes."""
    import random

    draw = random.Random(5)

    def card(n):
        body = "".join(str(draw.randrange(10)) for _ in range(n - 1))
        return next(body + str(c) for c in range(10) if plain_luhn(body + str(c)))

    def iban(country, n):
        body = "".join(str(draw.randrange(10)) for _ in range(n - 4))
        return next(x for c in range(2, 99) if plain_mod97(x := f"{country}{c:02}{body}"))

    fours = lambda x: " ".join(x[i : i + 4] for i in range(0, len(x), 4))
    values = [card(16), fours(card(16)), card(13), card(19), fours(iban("BE", 16)), fours(iban("DE", 22)), iban("NO", 15), "25/12/2020", "02/29/2024", "31.12.1999",
              "+14155552671", "+447911123456", "(415) 555-2671", "+49 30 1234567", "219-09-9999", "192.168.0.1", "2024/02/29"]
    around = [("pay ", " 12/25"), ("12 ", " 123"), ("acct ", " PAID"), ("", ""), ("no 7 ", ", then 99 more"), ("(", ")")]
    rows, want = [], []
    for v in values:
        for before, after in around:
            if v[0] == "(" and before == "(" or v[:4] == "+49 " and after == " 123":
                continue
            rows.append((len(rows), before + v + after))
            want.append((v, before, after))
    rows.append((len(rows), "none: 30/02/2020 13/13/2020 4111111111111112 BE00539007547034 1.2.3.400 000-12-3456 (015) 555-2671"))
    found = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), b"key").collect()}
    assert found[len(want)]["text"] == rows[-1][1]
    for i, (v, before, after) in enumerate(want):
        text = found[i]["text"]
        assert text.startswith(before) and text.endswith(after), (rows[i], text)
        new = text[len(before) : len(text) - len(after)]
        assert v == "192.168.0.1" or re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", v), (rows[i], text)
        assert new != v
        digits = "".join(re.findall("[0-9]", new))
        if v[0].isalpha():
            assert plain_mod97(new.replace(" ", ""))
        elif len(digits) > 12 and v[0] != "+":
            assert plain_luhn(digits)


def test_pseudonyms_are_one_to_one_in_the_corpus(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, LARGER).select("doc_id", "text").collect()}
    images: dict = {}
    total = 0
    for r in queries.op8_feistel_pseudonyms(spark, LARGER).collect():
        old, new, shift, at = texts[r["doc_id"]], r["text"], 0, 0
        for s in r["spans"]:
            value = new[s["start"] : s["end"]]
            start = s["start"] - shift
            assert old[at:start] == new[at + shift : s["start"]]
            length = len(re.match(r"[0-9.]+[0-9]", old[start:])[0]) if s["kind"] == "ip" else len(value)
            assert images.setdefault((s["kind"], old[start : start + length]), value) == value
            shift += len(value) - length
            at = start + length
            total += 1
        assert (old or "")[at:] == (new or "")[at + shift :]
    assert total and len(set(images.items())) == len({(k, v) for (k, _), v in images.items()})


# --- SentencePiece ----------------------------------------------------------------------------------------------------------


def test_ids_are_those_of_the_library(spark, odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for table in (documents(spark, LARGER), odd):
        texts = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        done = sentencepiece_codec.decode(sentencepiece_codec.encode(table, MODEL), MODEL).collect()
        found = {(r["doc_id"], None if r["ids"] is None else tuple(r["ids"]), r["text"]) for r in done}
        want = {(d, None if t is None else tuple(library.encode(t)), None if t is None else t.replace("▁", " ")) for d, t in texts}
        assert len(done) == len(texts) and found == want
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(none, MODEL), MODEL).count() == 0


# --- components and the pipeline ----------------------------------------------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(500, 560)] + [(1, i) for i in range(100, 300)] + [(7, 7), (900, 800), (800, 900)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 500 for i in range(500, 561)} | {i: 1 for i in [1, *range(100, 300)]} | {800: 800, 900: 800}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_stage_does_its_part(spark):
    from tests.llm.test_near_dedup import plain_classes
    from tests.llm.test_whole import lower

    docs = documents(spark, LARGER)
    columns = docs.columns
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        after = cut(stage(spark, docs, LARGER))
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name == "toxicity":
            scores = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
            assert kept == {r["doc_id"] for r in scores if r["score"] < 0.7}
        elif name == "exact_dedup":
            assert kept == {max(d for d, u in before.items() if lower(u) == lower(t)) for t in before.values()}
        elif name == "simhash":
            assert kept == {c for _, c in plain_classes(list(before.items()))[0]}
        elif name == "decontamination":
            found = decontaminate.leaks(docs, spark.read.parquet(f"{LARGER}/benchmark.parquet")).collect()
            assert kept == set(before) - {r["doc_id"] for r in found}
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
            rows = after.collect()
            assert {r["doc_id"]: r["ids"] for r in rows} == {d: library.encode(t or "") for d, t in before.items()}
            assert all(r["decoded_sha256"] == hashlib.sha256(before[r["doc_id"]].encode()).hexdigest() for r in rows)
            continue
        assert after.columns == columns and kept < set(before)
        docs = after


def test_stages_judge_each_row_by_its_text(spark, odd, none):
    for table in (odd, none):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            before = docs.collect()
            docs = cut(stage(spark, docs, SF))
            if name == "exact_dedup":
                assert docs.count() == len({exact_lower(r["text"]) for r in before})
            elif name == "sentencepiece":
                assert docs.count() == len(before)
            else:
                assert docs.columns == table.columns
                assert {(r["doc_id"], r["text"]) for r in docs.collect()} <= {(r["doc_id"], r["text"]) for r in before}
        assert docs.count() <= table.count()


def exact_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_repeated_and_absent_ids_are_judged_by_their_texts(spark):
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    base = " ".join(f"n{i}" for i in range(60))
    rows = [(1, "an innocent text"), (1, passage), (None, passage), (None, "another innocent text"), (2, base), (3, base + " end"), (3, "a third innocent text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {tuple(r) for r in corpus_pipeline.without_leaks(spark, docs, SF).collect()}
    assert kept == {r for r in rows if r[1] != passage}
    assert {tuple(r) for r in corpus_pipeline.without_near_copies(spark, docs, SF).collect()} == {r for r in rows if r not in ((None, passage), (3, base + " end"))}
    assert corpus_pipeline.without_toxic(spark, docs, SF).count() == len(rows)


def test_a_unigram_model_is_encoded_as_the_library_does(spark, tmp_path):
    import random

    from sentencepiece import sentencepiece_model_pb2

    draw, spec, made = random.Random(3), sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(open(MODEL, "rb").read())
    made.CopyFrom(spec)
    del made.pieces[:]
    for p in spec.pieces:
        if p.type != 1 or len(p.piece) == 1 or draw.random() < 0.3:
            made.pieces.add(piece=p.piece, score=-1 - 12 * draw.random() if p.type == 1 else 0, type=p.type)
    made.trainer_spec.model_type, made.trainer_spec.vocab_size = sentencepiece_codec.UNIGRAM, len(made.pieces)
    path = str(tmp_path / "unigram.model")
    open(path, "wb").write(made.SerializeToString())
    library, docs = sentencepiece.SentencePieceProcessor(model_file=path), documents(spark, SF)
    want = {r["doc_id"]: library.encode(r["text"] or "") for r in docs.collect()}
    total = lambda ids: sum(library.get_score(i) for i in ids)
    found = {r["doc_id"]: r["ids"] for r in sentencepiece_codec.encode(docs, path).collect()}
    assert found.keys() == want.keys()
    for d, ids in found.items():  # paths of equal sums, such as "o c oco" and "oco c o", differ by the rounding of whole texts' sums in the library
        assert ids == want[d] or (abs(total(ids) - total(want[d])) < 1e-3 * len(ids) and library.decode(ids) == library.decode(want[d]))
    made.trainer_spec.model_type = 4  # characters
    open(path, "wb").write(made.SerializeToString())
    with pytest.raises(ValueError):
        sentencepiece_codec.Codec(path)


def test_a_worker_drops_what_another_operator_left(spark):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(40)], "doc_id long, text string")

    def left(batches):
        batches = list(batches)
        before = len(sentencepiece_codec._codecs)
        list(common.slices(iter(batches)))
        yield pa.RecordBatch.from_pydict({"before": [before], "after": [len(sentencepiece_codec._codecs)]})

    assert sentencepiece_codec.encode(docs, TOKENIZER).count() == 40
    found = docs.repartition(8).mapInArrow(left, "before long, after long").collect()
    assert any(r["before"] for r in found) and not any(r["after"] for r in found)


def test_texts_go_to_workers_in_small_batches(spark, monkeypatch):
    seen, rows = [], spark.conf.get(corpus_pipeline.BATCH)

    def stage(spark, docs, _):
        most = docs.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        seen.append(max(r["n"] for r in most.collect()))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage)])
    assert corpus_pipeline.run(spark, str(DATA / "sf0.01")).count() == 1000
    assert seen == [int(corpus_pipeline.BATCH_ROWS)] and spark.conf.get(corpus_pipeline.BATCH) == rows


def test_stages_called_alone_have_small_batches(spark):
    docs, before = common.documents(spark, str(DATA / "sf0.01")).coalesce(1), spark.conf.get(corpus_pipeline.BATCH)
    stages = dict(corpus_pipeline.STAGES)
    try:
        for name in ("toxicity", "exact_dedup", "sentencepiece"):
            for given, most in (("10000", int(corpus_pipeline.BATCH_ROWS)), ("0", int(corpus_pipeline.BATCH_ROWS)), ("200", 200)):
                spark.conf.set(corpus_pipeline.BATCH, given)
                left = stages[name](spark, docs, str(DATA / "sf0.01")).coalesce(1)
                sizes = left.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
                assert sum(r["n"] for r in sizes) > 800 and max(r["n"] for r in sizes) <= most, (name, given)
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)
