"""Operators against brute force, on small rows with nulls, empty texts, ties and extra columns."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldstrata.llm import archives, common, decontam, licenses, lines, linking, mixing, neardup, pii, quality, tokens, toxicity
from fieldstrata.llm.linking import components

SF = "/root/testdata/sf0.001"
BLANK = [(90, None), (91, ""), (92, " \n\t")]


#: Two of the patterns in Python's spelling.
JAVA = {k: pii.PATTERNS[k] for k in ("email", "ip")}


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise("a")).withColumn("lang", F.lit(None).cast("string"))
    return df.withColumn("n", F.lit(1)).withColumn("id", F.lit("x")).withColumn("bucket", F.lit(2)) if extra else df


def prose(n, seed):
    g = random.Random(seed)
    return " ".join(g.choice(["stone", "river", "the", "of", "moss", "well", "spring", "flow"]) + str(g.randrange(400)) for _ in range(n))


def test_words_agree_with_pattern():
    for t in ("a b", "a\x1cb c", "a b c", " x y", "", None, "\x0b a\x0cb"):
        assert common.words(t) == (common._WORD.findall(t) if t else [])


def test_token_segments_round_trip():
    g = np.random.default_rng(3)
    for n in (0, 1, 255, 256, 257, 3000):
        ids = np.where(g.random(n) < 0.05, g.integers(0, 1 << 32, n), g.integers(0, 3000, n)).astype("<u4")
        d, lengths, got, start = tokens.decode_segment(tokens.encode_segment(np.array([5]), np.array([n]), ids, 17))
        assert (got == ids).all() and list(d) == [5] and list(lengths) == [n] and start == 17


def test_token_table(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(3, "two  spaces and\nlines "), (1, "café 日本 ² it's"), (2, prose(3000, 1)), (3, "same id"), *BLANK]
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = tokens.token_table(frame(spark, rows)).orderBy("start").collect()
    want, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = made.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert tokens.token_table(frame(spark, rows).limit(0)).count() == 0


def test_token_fast_path_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, made = tokens.Encoder(path), Tokenizer.from_file(path)
    added = [t.content for t in made.get_added_tokens_decoder().values()]
    texts = ["one two\n\nthree four", "a\n\n\nb c", "a\tb\t\tc", "one\ntwo three", "a b\n", *[f"end {t} start{t}x" for t in added], "x  y", "it's 12 o'clock"]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == made.encode(t, add_special_tokens=False).ids, t


def test_automaton_finds_what_brute_force_finds():
    g = random.Random(2)
    made = licenses.Automaton([("t", list("abcab")), ("u", list("bcabd"))], {"a b": "ab", "b": "b"})
    for _ in range(300):
        text = [g.choice("abcdx") for _ in range(g.randrange(1, 40))]
        starts, _ = made.scan(text)
        want = [(i, lab) for p, lab in ((["a", "b"], "ab"), (["b"], "b")) for i in range(len(text)) if text[i : i + len(p)] == p]
        assert sorted(starts) == sorted(want)
        subs = {tuple(s[i:j]) for s in (list("abcab"), list("bcabd"), ["a", "b"], ["b"]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for i, size, _ in made.statistics(text):
            assert size == max((n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in subs), default=0)


def test_templates_inside_others_are_found():
    made = licenses.Automaton([("short", list("abcde")), ("long", list("xabcdeyzwv"))], {})
    spans = made.scan(list("xabcde"))[1]
    assert ("short", 1.0) in {(made.templates[t][0], c) for t, _, _, c in spans}
    two = next(t for label, t in licenses.TEMPLATES if label == "bsd-2-clause")
    third = next(t for label, t in licenses.TEMPLATES if label == "bsd-3-clause")
    cut = two.index("THIS SOFTWARE")
    auto = licenses.automaton()
    of = lambda text: {auto.templates[s[0]][0] for s in auto.scan(licenses.tokens(text))[1] if s[3] >= 0.8}
    assert {"bsd", "bsd-2-clause", "bsd-3-clause"} <= of(two[:cut] + third + " " + two[cut:])
    # other holders' names, years and line breaks in between
    assert "mit" in of("(c) 2020 Someone " + next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 900).replace("AUTHORS", "OWNERS OF IT").replace(". ", ".\n * "))
    assert "cc-by-sa" in of("text licensed under CC BY-SA 3.0.") and "cc-by-nc" not in of("text licensed under CC BY-SA 3.0.")
    assert "cc-by-nc-nd" in of("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0")


def test_license_labels(spark):
    rows = [(1, "x y Released under the MIT License. z"), (2, "licensed under CC BY-NC 4.0; all rights reserved"), *BLANK]
    r = {x.doc_id: x for x in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert (r[1].labels, r[1].n_base, r[1].score) == ("mit", 0, 1.0)
    assert (r[2].base_labels, r[2].labels, r[2].first_word, r[2].last_word) == ("cc-by,reserved", "cc-by,cc-by-nc,reserved", 2, 7)
    assert (r[90].n_words, r[90].labels, r[90].score, r[90].first_word) == (0, "", 0.0, None)


def test_notices_are_told_apart(spark):
    of = lambda label, n=0: next(t for x, t in licenses.TEMPLATES if x == label and len(t) > n)
    want = [
        (of("gpl", 200), "gpl"),
        (of("lgpl", 200), "gpl,lgpl"),  # the phrase of the contract gives gpl
        (of("agpl", 200), "agpl,gpl"),
        (of("bsd-2-clause", 200), "bsd-2-clause"),
        ("CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa"),
        ("Licensed under CC BY-SA 3.0", "cc-by,cc-by-sa"),
        ("Creative Commons Attribution-NonCommercial-NoDerivatives", "cc-by-nc-nd"),
        ("licensed under Apache 2.0", "apache-2.0"),
        ("under the MIT licence", "mit"),
        ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl"),
        ("released under the MIT license and licensed under the Apache License version 2.0", "apache-2.0,mit"),
        ("the mitten licence of general publications", ""),
    ]
    got = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == [x for _, x in want]


def test_few_edits_equal_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    g = random.Random(12)
    for _ in range(400):
        a = "".join(g.choice("ab") for _ in range(g.randrange(14)))
        b = "".join(g.choice("ab") for _ in range(g.randrange(14))) if g.random() < 0.5 else a[: g.randrange(len(a) + 1)] + "b" + a[g.randrange(len(a) + 1) :]
        assert lines.few_edits(a, b, 40) == distance(a, b)
        assert lines.few_edits(a, b, 2) == (distance(a, b) if distance(a, b) <= 2 else None)


def test_very_long_lines_with_edits_at_both_ends():
    line = prose(120_000, 3)
    start = time.time()
    assert lines.edit_similarity("x" + line + "y", "z" + line[:500_000] + "q" + line[500_000:] + "w", 0.8) == pytest.approx(1 - 3 / (len(line) + 3))
    assert time.time() - start < 5


def test_surrogates(spark):
    rows = [(1, "mail a.b@x.org or A.B@X.ORG, call +1 (555) 123-4567 or +1 5551234567"), (2, "Mrs Anna Smith, Господин Иванов, 10.1.2.3"), (3, "a.b@x.org"), *BLANK]
    r = {x.doc_id: x for x in pii.replace_entities(frame(spark, rows)).collect()}
    first, second = r[1].text.split()[1], r[1].text.split()[3].rstrip(",")
    assert first.lower() == second.lower() != "a.b@x.org" and r[3].text == first
    digits = lambda s: "".join(c for c in s if c.isdigit())
    a, b = r[1].text.split("call ")[1].split(" or ")
    assert digits(a) == digits(b) and "5551234567" not in digits(a)
    assert "Anna" not in r[2].text and "Иванов" not in r[2].text and r[2].kinds == "ip,name"
    assert (r[90].text, r[91].text, r[91].n_entities) == (None, "", 0)
    other = {x.doc_id: x.text for x in pii.replace_entities(frame(spark, rows), key="k2").collect()}
    assert other[3] != r[3].text


def test_surrogates_stay_distinct(spark):
    ids = spark.createDataFrame([("ip", f"10.0.{a}.{b}") for a in range(6) for b in range(40)], "kind string, norm string")
    s = pii.surrogate(F.col("kind"), F.col("norm"), F.col("norm"), F.lit(0), "k")
    assert ids.select(s.alias("s")).distinct().count() == 240
    assert pii.assign(spark, ids, "k").count() == 0
    # short bodies collide: every one gets its own in the end
    few = spark.createDataFrame([("secret", f"{c}{n}") for c in "gh" for n in range(10)], "kind string, norm string")
    again = pii.assign(spark, few, "k")
    done = few.join(again, ["kind", "norm"], "left").withColumn("s", pii.surrogate(F.col("kind"), F.col("norm"), F.col("norm"), F.coalesce("attempt", F.lit(0)), "k"))
    assert done.select("s").distinct().count() == 20


def test_surrogates_never_run_out(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    full = spark.createDataFrame([("email", f"{a}@{b}.co") for a in letters for b in letters], "kind string, norm string")
    again = pii.assign(spark, full, "k")
    done = full.join(again, ["kind", "norm"], "left").select("norm", pii.surrogate(F.col("kind"), F.col("norm"), F.col("norm"), F.coalesce("attempt", F.lit(0)), "k").alias("s"))
    rows = done.collect()
    assert len({r.s for r in rows} - {r.norm for r in rows}) == 676
    one = spark.createDataFrame([("surname", "Smith", a) for a in range(4)], "kind string, norm string, attempt int")
    got = [r.s for r in one.select("attempt", pii.surrogate(F.col("kind"), F.col("norm"), F.col("norm"), F.col("attempt"), "k").alias("s")).orderBy("attempt").collect()]
    assert [len(x) for x in got] == [9, 11, 13, 15]


def test_surrogates_of_rows_without_an_id_and_of_bare_surnames(spark):
    rows = [(1, "Señora Ana María López paid. López left; Mr John Smith called. Smith paid, not Smithson or Smith-Jones."), (None, "Mr Smith wrote")]
    rows += [(100 + i, f"mail {chr(97 + i % 26)}@{chr(97 + i // 26)}.co") for i in range(676)]
    rows += [(None, t) for _, t in rows[2:302]]
    got = pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    one = next(r.text for r in got if r.doc_id == 1)
    assert not set(re.findall(r"\w+", one)) & {"Ana", "María", "López", "John", "Smith"} - {"Smith"} and "Smith paid" not in one and one.endswith("not Smithson or Smith-Jones.")
    with_ids, without = {r.text for r in got if r.doc_id and r.doc_id >= 100}, {r.text for r in got if r.doc_id is None and r.text.startswith("mail")}
    assert len(with_ids) == 676 and len(without) == 300 and without <= with_ids
    assert next(r.text for r in got if r.doc_id is None and r.text.startswith("Mr")).split()[1] in one


def test_surrogates_corefer_and_keep_their_type(spark):
    rows = [
        (1, "Mr John Smith met Mrs Smith. Later John Smith left John Smithson."), (2, "Mr Smith and Mr JOHN Smith; Mrs John Brown"), (3, "+1 555 123-4567 or +15551234567 or +44 20 7946 0958"),
        (4, "card 4111 1111 1111 1111 and 5500-0000-0000-0004, 4111111111111111"), (5, "DE89 3704 0044 0532 0130 00 and GB29NWBK60161331926819"), *BLANK,
    ]
    r = {x.doc_id: x.text for x in pii.replace_entities(frame(spark, rows)).collect()}
    w = r[1].replace(".", "").split()
    assert w[1:3] == w[7:9] == [w[1], w[5]] and w[-1] == "Smithson" and "Smith " not in r[1] and w[10] == "John"
    v = re.split(r"[ ;]+", r[2])
    assert v[1] == v[5] == w[2] and v[4] == w[1].upper() and v[7] != w[1]
    digits = [re.sub("[^0-9]", "", p) for p in r[3].split(" or ")]
    assert digits[0] == digits[1] != "15551234567" and digits[0][0] == "1" and digits[2].startswith("44")

    def luhn(n):
        return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(n))) % 10 == 0

    cards = [re.sub("[^0-9]", "", c) for c in re.findall("[0-9][0-9 -]{14,}", r[4])]
    assert len(cards) == 3 and all(map(luhn, cards)) and cards[0] == cards[2] != "4111111111111111" and [c[0] for c in cards] == list("454")
    ibans = [c.replace(" ", "") for c in r[5].split(" and ")]
    assert all(int("".join(str(int(c, 36)) for c in i[4:] + i[:4])) % 97 == 1 for i in ibans) and [i[:2] for i in ibans] == ["DE", "GB"] and ibans[0] != "DE89370400440532013000"


def test_surrogates_equal_brute_force(spark):
    """Over the documents' own mentions: equal entities are replaced alike, different ones differently, all of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    new = {x.doc_id: x.text for x in pii.replace_entities(docs).collect()}
    to, back = {}, {}
    for r in docs.collect():
        old = r.text or ""
        for kind in ("email", "ip"):
            a, b = (re.findall(JAVA[kind], t or "") for t in (old, new[r.doc_id]))
            assert len(a) == len(b)
            for x, y in zip(a, b, strict=True):
                assert to.setdefault((kind, x.lower()), y.lower()) == y.lower() != x.lower()
                assert back.setdefault((kind, y.lower()), x.lower()) == x.lower()
    assert len(to) > 5


def test_tiling_counts_reordered_passages():
    item = list(range(1, 31))
    got = decontam.tile(item, item[20:] + [99] + item[10:20] + [98] + item[:10], 5)
    assert sum(n for *_, n in got) == 30 and len(got) == 3
    assert decontam.tile(item, [99] + item[:4] + [99], 5) == []


def test_decontamination(spark):
    item = prose(40, 7)
    w = item.split()
    items = spark.createDataFrame([(1, item), (2, None), (3, "short item"), (4, prose(30, 8))], "item_id long, text string")
    rows = [(1, prose(60, 1)), (2, f"{prose(20, 2)} {item.upper()} tail"), (3, " ".join([*w[20:], "x", *w[:20]])), (4, "short item"), *BLANK]
    r = {(x.doc_id, x.item_id): x for x in decontam.contaminated(frame(spark, rows), items).collect()}
    assert set(r) == {(2, 1), (3, 1), (4, 3)} and r[3, 1].tiles == 2 and r[3, 1].coverage == 1.0
    blocks = decontam.contaminated(frame(spark, rows), items, block_chars=100)
    assert {(x.doc_id, x.item_id) for x in blocks.collect()} == set(r)


def test_arc_versions_and_warc(spark):
    for version in "12":
        _, *got = archives.read_arc(archives.write_arc("n", [("http://a/ b".replace(" ", "%20"), "1.2.3.4", "20240102030405", "text/html", b"x\ny\n"), ("u", "-", "20240102030405", "t", b"")], version))
        assert [g["body"] for g in got] == [b"x\ny\n", b""] and got[0]["archive-length"] == "4"
    html = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\né</p>"
    pages = spark.createDataFrame([(1, "http://x/ y", html), (2, None, html), (3, "u", None), (4, "u", ""), (5, "v", "z")], "page_id long, url string, html string").withColumn("n", F.lit(0))
    r = {x.page_id: x for x in archives.convert_pages(pages, "2").collect()}
    assert [(r[i].record_type, r[i].refers_to) for i in range(1, 6)] == [("revisit", 2), ("response", None), ("revisit", 4), ("response", None), ("response", None)]
    assert r[1].payload_bytes == len(html.encode()) and r[1].payload_digest == archives.base32_sha1(html.encode())


def test_archives_of_bytes_types_and_faults(spark, tmp_path):
    latin = "HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\ncaf\u00e9 \u00df".encode("latin-1")
    good = archives.write_arc("a.arc", [("http://x/", "1.2.3.4", "20010203040506", "text/html", latin), ("dns:x", "1.2.3.4", "20010203040506", "text/dns", b"x A 1.2.3.4"), ("http://x/2", "-", "2001ab", "text/html", latin), ("http://x/3", "-", "20010203", "text/html", latin)])
    rows = [("a.arc", good), ("cut.arc", good[: len(good) - 20]), ("odd.arc", good[:150] + b"no header here\n"), ("empty.arc", b""), ("null.arc", None)]
    arcs = spark.createDataFrame(rows, "name string, arc binary")
    wrong = sorted(r.error for r in archives.rejects(arcs).collect())
    assert len(wrong) == 4 and wrong[0].startswith("a.arc") and "date" in wrong[0] and any("beyond" in w for w in wrong)
    path = str(tmp_path / "warc")
    archives.write_warc(spark, arcs.where("name = 'a.arc'"), path)
    got = {r.uri: r for r in archives.read_warc(spark, path).collect()}
    assert {u: r.record_type for u, r in got.items()} == {None: "warcinfo", "http://x/": "revisit", "dns:x": "resource", "http://x/3": "response"} or got["http://x/"].record_type == "response"
    assert got["http://x/3"].payload_bytes == got["http://x/"].payload_bytes == 6 and got["http://x/3"].payload_digest == archives.base32_sha1("caf\u00e9 \u00df".encode("latin-1"))


def test_mix_stage_keeps_sources_apart(spark):
    docs = spark.createDataFrame([(1, "x", "a b " * 50), (1, "y", "c d")] + [(i, "z", prose(40, i)) for i in range(2, 40)], "doc_id long, source string, text string")
    took = {(r.doc_id, r["size"], r.source_size): r for r in mixing.mix_sources(docs).collect()}
    rows = Counter((r.doc_id, r.source) for r in mixing.stage(spark, docs, SF).collect())
    for source, size in (("x", 100), ("y", 2)):
        r = next(r for r in took.values() if r.doc_id == 1 and r["size"] == size)
        assert rows[1, source] * size == r.taken


def test_token_fuzz_against_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, made, g = tokens.Encoder(path, cap=500), Tokenizer.from_file(path), random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "'s", "'", '"', "don't", "I'll", ".", ",", "!?", "12", "3.5", "\u00e9", "\u00df", "\u00aa", "\u00ba", "\u00b2", "\u00bc", "\u00d7", "<|endoftext|>", "<|", "\t", "\r", "\u65e5\u672c", "\u017f", "\u01c5", "\u024f", "\u2026", "_", "-", "x)", "(y", "'re", "'LL", *map(chr, range(0xA0, 0x250, 7))]
    for _ in range(20_000):
        t = "".join(g.choice(parts) for _ in range(g.randrange(1, 12)))
        assert np.frombuffer(encode(t), "<u4").tolist() == made.encode(t, add_special_tokens=False).ids, t


def test_fuzzy_lines_of_a_repeated_doc_id(spark):
    rows = [(1, "first line of one\nsecond line here"), (1, "another text"), (1, "first line of one\nsecond line here"), (2, "second line here"), *BLANK]
    df = frame(spark, rows)
    g = lines.line_groups(df)
    kept = {(r.doc_id, r.line, r.kept) for r in g.collect()}
    assert kept == {(1, 0, True), (1, 1, True), (2, 0, False)}
    assert sorted(r.text or "" for r in lines.drop_lines(df, g).where("doc_id < 3").collect()) == sorted(["", *[t for _, t in rows[:3]]])


def test_fuzzy_lines_recall(spark):
    """Pairs of the distinct lines of the documents at 0.8 or more, by brute force: at least 0.9 share a key."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    once = sorted({n for t in texts for x in (t or "").split("\n") if (n := lines.normalise(x)) and len(n) < 2000}, key=len)
    profiles, sizes = lines._profiles(once), np.array([len(x) for x in once])
    keys = [set(k) for k in lines.candidate_keys(once)]
    near = found = 0
    for i in range(len(once)):
        high = np.searchsorted(sizes, sizes[i] / 0.8 + 1e-9, side="right")
        if high > i + 1:
            edits = lines._least_edits(profiles[i + 1 : high], profiles[i])
            for j in (np.flatnonzero(edits <= 0.2 * sizes[i + 1 : high] + 1e-9) + i + 1).tolist():
                if lines.edit_similarity(once[i], once[j], 0.8) >= 0.8:
                    near, found = near + 1, found + bool(keys[i] & keys[j])
    assert near >= 20 and found >= 0.9 * near


def test_profiles_never_ask_for_too_many_edits():
    g = random.Random(9)
    for _ in range(300):
        a = "".join(g.choice("abcd") for _ in range(g.randrange(1, 40)))
        b = list(a)
        for _ in range(g.randrange(6)):
            at = g.randrange(len(b) + 1)
            b[at : at + g.randrange(2)] = g.choice(["", "x", "b"])
        b = "".join(b) or "a"
        edits = (1 - lines.edit_similarity(a, b)) * max(len(a), len(b))
        assert lines._least_edits(lines._profiles([a]), lines._profiles([b]))[0] <= edits + 1e-6


def test_crowded_keeps_buckets_with_company(spark):
    g = random.Random(5)
    rows = [(g.randrange(300), i) for i in range(400)] + [(7, i) for i in range(1000, 4000)] + [(900, 1), (900, 1)]
    got = {(r.bucket, r.id) for r in linking.crowded(spark, spark.createDataFrame(rows, "bucket long, id long").repartition(5)).collect()}
    by = Counter(b for b, _ in set(rows))
    want = {r for r in rows if by[r[0]] > 1}
    assert want <= got and len(got - want) <= 2 * 4  # besides the ends of a task's range


def test_crowded_keeps_buckets_that_end_with_a_batch():
    rows = [(1, 1), (1, 2), (2, 3), (2, 4), (2, 4), (3, 5), (3, 6), (3, 7), (4, 8), (5, 9), (5, 10), (6, 11)]
    for size in range(1, len(rows) + 1):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in p], pa.int64()) for k in (0, 1)], names=["bucket", "id"]) for p in parts]
        got = [r for b in linking._runs(iter(batches)) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        want = [r for r in dict.fromkeys(rows) if r[0] not in (4, 6)]
        # every row with company, once, besides the ends
        assert sorted(set(got) | {(6, 11)}) == sorted([*want, (6, 11)]) and len(got) == len(set(got)), size


def test_mix_targets(spark):
    rows = [(i, prose(10 + i % 50, i)) for i in range(300)] + BLANK
    df = frame(spark, rows).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")))
    r = mixing.mix_sources(df).collect()
    total = sum(x["size"] for x in r)
    assert abs(sum({x.doc_id % 4: x.target for x in r}.values()) - total) < 1e-6 * total
    by = Counter()
    for x in r:
        assert x.taken <= 3 * x["size"] and (x["size"] == 0 or x.taken % x["size"] == 0)
        by[x.doc_id % 4, x.target] += x.taken
    assert all(abs(t - n) <= 60 for (_, t), n in by.items())
    assert sorted(map(tuple, r)) == sorted(map(tuple, mixing.mix_sources(df).collect()))


def test_edit_similarity():
    def slow(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return 1 - p[-1] / max(len(a), len(b), 1)

    g = random.Random(1)
    for _ in range(200):
        a, b = ("".join(g.choice("abc") for _ in range(g.randrange(1, 80))) for _ in range(2))
        assert lines.edit_similarity(a, b) == pytest.approx(slow(a, b))


def test_fuzzy_lines(spark):
    long = prose(60, 4)
    near = long + " more"
    rows = [(1, f"{long}\nown line one"), (2, f"{near}\nown line two here"), (3, f"{long.upper()}!!\n"), *BLANK]
    g = {(x.doc_id, x.line): x for x in lines.line_groups(frame(spark, rows)).collect()}
    assert g[1, 0].kept and not g[2, 0].kept and not g[3, 0].kept and g[1, 1].kept and g[2, 1].kept
    texts = {x.doc_id: x.text for x in lines.drop_lines(frame(spark, rows), lines.line_groups(frame(spark, rows))).collect()}
    assert texts[2] == "own line two here" and texts[90] is None and texts[91] == ""


def test_short_lines_share_a_segment_key():
    g = random.Random(8)
    for _ in range(3000):
        a = "".join(g.choice("abcd ") for _ in range(g.randrange(5, 25)))
        b = list(a)
        for _ in range(g.randrange(1, 5)):
            at = g.randrange(len(b))
            b[at : at + g.randrange(2)] = g.choice(["", "e", "a", "bc"])
            b = b or ["a"]
        b = "".join(b)
        if a != b and len(b) <= lines.EXACT and lines.edit_similarity(a, b) >= 0.8:
            assert {*lines.segment_keys(a)} & {*lines.segment_keys(b)}, (a, b)


def test_fuzzy_lines_of_all_lengths(spark):
    short = ["green moss", "a cold spring", "water flows here", "moss grows on the stone"]
    rows = [(i, x) for i, x in enumerate(short)] + [(10 + i, x[:4] + "x" + x[5:]) for i, x in enumerate(short)]
    for k, n in enumerate((8, 11, 30, 101)):
        w = prose(n, 50 + k).split()
        rows += [(20 + k, " ".join(w)), (30 + k, " ".join([*w[: n // 2], "changed", *w[n // 2 + 1 :]]))]
    g = {x.doc_id: x for x in lines.line_groups(frame(spark, rows)).collect()}
    assert {i for i, x in g.items() if not x.kept} == {*range(10, 14), *range(30, 34)}
    assert all(g[i].group_id == g[i - 10].group_id for i in (*range(10, 14), *range(30, 34)))


def test_bag_signatures_estimate_weighted_jaccard():
    g = np.random.default_rng(5)
    shingle = g.integers(0, 2**63, 400).astype(np.uint64)
    wa, wb = g.integers(0, 9, 400), g.integers(0, 9, 400)
    row = np.repeat([0, 1], 400)
    both, w = np.concatenate([shingle, shingle]), np.concatenate([wa, wb])
    sig = neardup.bag_signatures(both[w > 0], row[w > 0], w[w > 0], 2, 4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.03)


def brute_tiles(item, doc, least=5):
    """Again and again the longest run in common of what is unmarked, the first of equals."""
    a, b, tiles = list(item), list(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for d in range(len(b)):
                n = 0
                while i + n < len(a) and d + n < len(b) and a[i + n] == b[d + n] and a[i + n] > 0:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least:
            return tiles
        a[i : i + n], b[d : d + n] = [-1] * n, [-2] * n
        tiles.append((i, d, n))


def test_tiles_equal_brute_force():
    g = random.Random(11)
    for _ in range(400):
        k = g.choice([1, 2, 3, 8, 30])
        item, doc = [g.randrange(1, k + 1) for _ in range(g.randrange(1, 40))], [g.randrange(k + 1) for _ in range(g.randrange(1, 50))]
        if g.random() < 0.5:
            i = g.randrange(len(item))
            doc[len(doc) // 2 : len(doc) // 2] = item[i:] + [0] + item[:i]
        assert sorted(n for *_, n in decontam.tile(item, doc)) == sorted(n for *_, n in brute_tiles(item, doc))


def test_tiles_of_equal_words_take_no_cubic_time():
    start = time.time()
    assert decontam.tile([1] * 6000 + list(range(2, 3000)), [1] * 9000) == [(0, 0, 6000)]
    index = decontam.Index([(1, "x " * 6000 + " ".join(f"w{i}" for i in range(3000)))])
    at, value = index.hits(np.full(9000, index.words["x"], np.uint64))
    assert list(index.matches(np.full(9000, index.words["x"], np.uint64), at, value, 0.5)) == [(1, 9000, 6000, 1)]
    assert time.time() - start < 20


def test_near_duplicates_equal_brute_force(spark):
    base = prose(200, 9).split()
    rows = [(i, prose(120, 100 + i)) for i in range(20)]
    for i in range(60):  # one large family of near copies, more than a small bucket
        t = list(base)
        for j in range(1 + i % 12):  # some too far from the middle, but near each other
            t[(3 * i + 16 * (j + i % 2)) % 200] = f"changed{i % 7}"
        rows.append((200 + i, " ".join(t)))
    rows += [(300 + i, " ".join(base)) for i in range(3)] + [(400, "one two"), (401, "one two"), *BLANK, (92, " \n\t")]
    got = {x.doc_id: x for x in neardup.near_duplicates(frame(spark, rows)).collect()}
    bags = {i: Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) for i, t in rows if (w := (t or "").split())}
    par = {i: i for i, _ in rows}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                x, y = sorted((find(a), find(b)))
                par[y] = x
    assert {i: x.class_id for i, x in got.items()} == {i: find(i) for i in par}
    sizes = Counter(find(i) for i in par)
    assert all(x.class_size == sizes[x.class_id] for x in got.values()) and max(sizes.values()) > 20


def test_overlaps_count_shared_elements():
    g = np.random.default_rng(3)
    rows = [np.unique(g.integers(0, 300, n)) for n in (0, 1, 40, 90, 200)]
    shared = np.unique(g.integers(0, 300, 150))
    got = neardup.overlaps(rows, rows[1:], shared, columns=16)
    assert got.tolist() == [[len({*a} & {*b} & {*shared}) for b in rows[1:]] for a in rows]
    assert not neardup.overlaps(rows, rows, shared[:0]).any()


def test_components(spark):
    g = random.Random(6)
    edges = [(g.randrange(200), g.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(500, 560)]
    edges = [e for e in edges if e[0] != e[1]]
    par = {x: x for e in edges for x in e}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        par[y] = x
    got = {r.id: r.comp for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in par}


def test_network_gradients():
    net = toxicity.Network(1)
    g = np.random.default_rng(2)
    x = g.standard_normal((12, 2 * toxicity.DIM)).astype(np.float32)
    index, mask = g.integers(0, 12, (7, 5)), np.ones((7, 5, 1), np.float32)
    mask[5:, 2] = 0
    y = np.array([0, 1, 1, 0, 1], np.float32)

    def loss():
        a, b = net.project(x)
        z = net.run(a[index], b[index], mask)[0].astype(np.float64)
        return np.mean(np.logaddexp(0, z) - y * z)

    grads, _ = net.gradients(index, mask, x, y)
    for k, d in grads.items():
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        old, e = net.p[k][at], 1e-2
        net.p[k][at] = old + e
        up = loss()
        net.p[k][at] = old - e
        down = loss()
        net.p[k][at] = old
        assert d[at] == pytest.approx((up - down) / (2 * e), rel=0.08, abs=2e-4), k


def test_toxicity_learns(spark):
    g = random.Random(3)
    make = lambda bad: " ".join(g.choice(["vile", "nasty"]) if bad and g.random() < 0.1 else prose(1, g.random()) for _ in range(80))
    rows = [(i, make(i % 2)) for i in range(400)] + BLANK
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    net = toxicity.fit(docs, labels)
    r = [x for x in toxicity.score_documents(docs, net).collect()]
    held = [x for x in r if x.held_out and x.doc_id < 90]
    assert np.mean([x.predicted == x.doc_id % 2 for x in held]) > 0.9
    assert all(0 <= x.score <= 1 for x in r) and len(r) == 403
    assert toxicity.score_documents(docs, toxicity.fit(docs, labels.limit(0))).where("predicted = 1").count() == 0


def test_quality_base_equals_brute_force(spark):
    g = random.Random(8)
    rows = [(i, "\n".join(" ".join(g.choice("ab cd#e f$ gg".split()) for _ in range(g.randrange(0, 9))) for _ in range(g.randrange(1, 12)))) for i in range(60)] + BLANK
    got = {x.doc_id: x for x in quality.judge(frame(spark, rows)).collect()}
    for i, t in rows:
        w = common.words(t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = Counter(tri)
        covered = {k + j for k, x in enumerate(tri) if c[x] > 1 for j in range(3)}
        ls = [x for x in (t or "").split("\n") if common.words(x)]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(ls) - len(set(ls)), len(covered))
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i].base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_keeps_good_labels(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    r = quality.judge(d).join(spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").where("not base_failed").collect()
    assert all(x.kept for x in r if x.label == 1)


def test_pipeline(spark):
    import corpus_pipeline

    r = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert r and r[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(r, r[1:], strict=False))


def test_toxicity_reads_long_words_to_the_end():
    assert toxicity.char_rows("a" * 40 + "stupid") != toxicity.char_rows("a" * 40 + "lovely")
    long = "stone/river_" * 30 + "idiot" + "日本語の文章" * 40
    got = toxicity.units(f"one two {long} end")
    assert got[:2] == ["one", "two"] and got[-1] == "end" and "idiot" in toxicity.units("stone/river_" * 30 + "idiot_moss")
    assert max(map(len, got)) <= toxicity.LONGEST
    seen = {w[i : i + 3] for w in got for i in range(len(w) - 2)}
    assert all("語の文章日本語"[i : i + 3] in seen for i in range(5))
    rows = [("stone river " + prose(20, i) + (" idiot" if i % 2 else " flower") + " moss", i % 2) for i in range(400)]
    score = toxicity.Scorer(toxicity.train(rows))
    bad, good = score(["stone_river_" * 10 + "idiot_moss", "stone_river_" * 10 + "flower_moss"])
    assert bad > 0.5 > good


def test_toxicity_on_held_out_documents(spark):
    """Held-out rows of the tables: the network never saw their labels."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in toxicity.op9_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= 0.95
    assert sum(r.predicted for r in held if not labels[r.doc_id]) <= 0.02 * len(held)


def test_keys_met_by_another_id(spark, monkeypatch):
    rng = np.random.default_rng(5)
    keys = [mixed.tolist() for mixed in common.mix(rng.integers(0, 4000, (1500, 4)).astype(np.uint64)).view(np.int64)]
    hot = int(common.mix(np.array([1 << 40], np.uint64)).view(np.int64)[0])
    rows = [(i % 1200, sorted({*keys[i % 1200], *([hot] if i % 1200 < 700 else [])})) for i in range(1500)]
    holders: dict[int, set[int]] = {}
    for i, ks in rows:
        for k in ks:
            holders.setdefault((k % (1 << 64)) >> 23, set()).add(i)
    want = {(k, i) for k, ids in holders.items() if len(ids) > 1 for i in ids}
    df = spark.createDataFrame(rows, "id long, keys array<long>").repartition(5)
    got = linking.met(df).collect()
    assert {(r.bucket, r.id) for r in got} == want
    assert {r.n for r in got if r.bucket == (hot % (1 << 64)) >> 23} <= set(range(linking.PART_IDS, 701))
    # in one process with many packs: no group holds more of the frequent bucket than each pack may send
    monkeypatch.setattr(linking, "PACK", 500)
    packs = list(linking._packs(pa.RecordBatch.from_pydict({"id": [i for i, _ in rows[a : a + 200]], "keys": pa.array([k for _, k in rows[a : a + 200]], pa.list_(pa.int64()))}) for a in range(0, 1500, 200)))
    assert len(packs) == 8
    t = pa.Table.from_batches(packs)
    groups: dict[tuple, list[int]] = {}
    for n, (part, salt) in enumerate(zip(t["part"].to_pylist(), t["salt"].to_pylist(), strict=True)):
        groups.setdefault((part, salt), []).append(n)
    got = [{(r["bucket"], r["id"]) for r in linking._unpacked(t.take(g)).to_pylist()} for g in groups.values()]
    assert set().union(*got) == want
    most = max(sum(b == (hot % (1 << 64)) >> 23 for b, _ in g) for g in got)
    assert most <= 8 * linking.PART_IDS < 700


def test_only_texts_of_lines_that_share_a_key_move(spark):
    rows = [(i, "\n".join(f"line {i} {k} of text" for k in range(20))) for i in range(500)]
    wanted = [(i, k) for i in range(0, 500, 7) for k in (3, 19)]
    sketch = lines.line_sketch(spark.createDataFrame(wanted, "doc_id long, line int"), len(wanted))

    class Value:
        value = sketch

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    got = [x for b in lines._line_texts(Value)(iter([batch])) for x in b.column(1).to_pylist()]
    assert {lines.normalise(f"line {i} {k} of text") for i, k in wanted} <= set(got)
    assert len(got) < len(wanted) + 0.05 * 10_000


def test_stored_tables_leave_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    t = common.stored(spark, spark.range(5000).groupBy((F.col("id") % 100).alias("k")).count().repartition(3), "no-shuffle-left")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and t.count() == 100  # counting has a shuffle of its own
