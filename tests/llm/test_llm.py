import base64
import itertools
import os
import random
import shutil
import zlib

import numpy as np
import pandas as pd
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import encoding, harm, packing, pairs, repeated_lines, scan_noise, splitting
from corvane.llm.items import items
from corvane.llm.queries import QUERIES
from tests.conftest import DATA

CHUNK = "id string, text string, source string, chunk_index int, publisher string, metadata string, indexed_at timestamp, lines string, site string"
PLAN = "source string, title string, metadata string, pages array<string>, kind string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def empty(spark, schema):
    return spark.createDataFrame([], schema)


# ---------------------------------------------------------------- splitting


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .\n#|,é́日")), max_size=400), st.integers(0, 16), st.integers(48, 60))
def test_pieces_rebuild_the_text(text, overlap, limit):
    pieces = splitting.cut(text, limit, overlap)
    assert all(len(p) <= limit for p in pieces)
    assert all(b[:overlap] == a[-overlap:] for a, b in zip(pieces, pieces[1:])) or overlap == 0
    assert pieces[0] + "".join(p[overlap:] for p in pieces[1:]) == text


def test_cuts_at_the_strongest_boundary():
    text = "x" * 30 + "\n\n" + "y. " * 10
    assert splitting.bodies(text, 50)[1] == 32
    assert len(splitting.cut("a" * 100_000)) == len(splitting.bodies("a" * 100_000, 2200))
    with pytest.raises(ValueError):
        splitting.cut("a", 100, 34)


def test_oversized_items(spark):
    long = "word " * 600
    plans = spark.createDataFrame([("s", None, None, [long, None, "x"], "k"), ("s", None, None, [long, None, "x"], "k"), ("t", None, None, None, "k")], PLAN)
    chunks = spark.createDataFrame([("c", long, "f", 0, None, None, None, None, None), ("d", None, "f", 1, None, None, None, None, None)], CHUNK)
    assert rows(splitting.oversized(items(plans, chunks))) == [("chunk", "c", 0), ("page", "s", 1)]
    assert splitting.oversized(items(empty(spark, PLAN), empty(spark, CHUNK))).count() == 0


# ---------------------------------------------------------------- encoding


@pytest.fixture(scope="module")
def reference():
    with open(encoding.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_of_any_text(reference, text):
    enc = encoding.encoder(encoding.vocabulary_path())
    assert enc.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_ids_of_documents(spark, reference):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "aa" * 20_000), (-5, "<|endoftext|>")], "doc_id bigint, text string"), allowMissingColumns=True).withColumn("ids", F.lit("clash"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in encoding.encode_corpus(docs).collect()}
    assert got == {k: reference.encode_ordinary(t) if t else [] for k, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in encoding.token_counts(docs).collect()} == {k: len(v) for k, v in got.items()}
    assert encoding.encode_corpus(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60), st.sampled_from(["norm", "dot"]))
def test_best_fit_keeps_every_capacity(sizes, rule):
    sizes = np.array(sizes, int)
    own = packing.best_fit(sizes, 100, max_documents=7, attention=6000 if sizes.size and sizes.max() <= 77 else None, rule=rule)
    for b in set(own.tolist()):
        assert sizes[own == b].sum() <= 100 and (own == b).sum() <= 7
        if sizes.max() <= 77:
            assert (sizes[own == b] ** 2).sum() <= 6000
    assert len(own) == len(sizes)
    if rule == "norm" and sizes.size and sizes.max() > 77:
        assert len(set(own.tolist())) <= 2 * max(-(-sizes.sum() // 100), -(-len(sizes) // 7)) + 1


def test_attention_binds_only_below_the_square_of_the_capacity():
    sizes = np.array([50, 50, 50, 50])
    assert len(set(packing.best_fit(sizes, 100))) == len(set(packing.best_fit(sizes, 100, attention=100.0**2))) == 2
    assert len(set(packing.best_fit(sizes, 100, attention=4999.0))) == 4


def test_containers(spark):
    random.seed(3)
    sizes = [(i, random.choice([0, 3, 40, 400, 1500, 2048, 5000])) for i in range(500)] + [(1000, None)]
    got = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint").repartition(3)).collect()
    docs, per = {}, {}
    for r in got:
        docs.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
        per[r.container_id] = per.get(r.container_id, 0) + r.n_tokens
    assert max(per.values()) <= 2048
    for i, n in sizes:
        parts = sorted(docs[i])
        assert sum(x for _, x in parts) == (n or 0) and (len(parts) == 1 or n > 2048)
        assert all(s + x == t for (s, x), (t, _) in zip(parts, parts[1:]))
    assert len(per) <= 1.03 * sum(n or 0 for _, n in sizes) / 2048 + 3
    assert packing.pack(empty(spark, "doc_id bigint, n_tokens bigint")).count() == 0


# ---------------------------------------------------------------- repeated lines


def chunk(i, text, source, publisher):
    return (i, text, source, 0, publisher, None, None, "clash", "clash")


def site(spark):
    notice = ["(c) 2019 All rights reserved", "© 2021 ALL  RIGHTS reserved.", "*&copy; all rights reserved, 3 March 2020*", "<b>All rights</b> reserved", "all-rights reserved 1st May", "Other 1"]
    out = [chunk(f"c{i}", f"body {chr(97 + i)} text\n{n}\n---\n12", f"f{i}", "WWW.Site.org " if i else None) for i, n in enumerate(notice)]
    out.append(chunk("c9", "more\nall rights reserved", "f0", "site.org"))
    out += [chunk("n1", None, "f1", None), chunk("n2", "all rights reserved", None, "site.org"), chunk("n3", "all rights reserved", "g", None), chunk("n4", "all rights reserved", "h", "else.org")]
    return spark.createDataFrame(out + out[:2], CHUNK)


SITE = [("c0", 2), ("c1", 2), ("c2", 2), ("c3", 2), ("c4", 2), ("c9", 2)]


def test_repeated_lines(spark):
    chunks = site(spark)
    assert rows(repeated_lines.repeated_lines(chunks)) == SITE
    clean = {r.id: r.text for r in repeated_lines.without_lines(chunks, repeated_lines.repeated_lines(chunks)).collect()}
    assert clean["c0"] == "body a text\n---\n12" and clean["c5"].endswith("Other 1\n---\n12") and clean["n1"] is None
    assert repeated_lines.repeated_lines(empty(spark, CHUNK)).count() == 0


def test_merging_in_parts_gives_the_same(spark):
    chunks = site(spark)
    first = chunks.filter(F.col("id").isin("c0", "c1", "c2", "n1", "n4"))
    zero = repeated_lines.open_state(spark)
    a = repeated_lines.merge(zero, first)
    assert a.repeated.count() == 0 and zero.repeated.count() == 0
    b = repeated_lines.merge(a, chunks.join(first.select("id"), "id", "left_anti"))
    risen, fallen = repeated_lines.crossed(a, b)
    assert risen.count() == 1 and fallen.count() == 0
    assert rows(repeated_lines.occurrences(b)) == SITE
    # Many new documents without the line take it below a fifth again; the chunks that held it are built again.
    more = spark.createDataFrame([chunk(f"m{i}", f"unlike {'x' * i}", f"m{i}", "site.org") for i in range(40)], CHUNK)
    c = repeated_lines.merge(b, more)
    assert repeated_lines.crossed(b, c)[1].count() == 1 and repeated_lines.occurrences(c).count() == 0
    built = {r.id: r.text for r in repeated_lines.rebuild(b, c, chunks.unionByName(more)).collect()}
    assert set(built) == {i for i, _ in SITE} | {f"m{i}" for i in range(40)} and "rights" in built["c0"].lower()


def test_a_state_is_found_again_by_its_name(spark, tmp_path):
    chunks, path = site(spark), str(tmp_path / "state")
    first = chunks.filter("id < 'c3'")
    assert repeated_lines.merge(repeated_lines.open_state(spark, path), first).version == 1
    again = repeated_lines.open_state(spark, path)
    assert again.version == 1 and repeated_lines.open_state(spark, str(tmp_path / "none")).version == 0
    assert rows(repeated_lines.occurrences(repeated_lines.merge(again, chunks.filter("id >= 'c3'")))) == SITE
    # A merge that was lost before its end isn't seen, and is done again.
    shutil.rmtree(f"{path}/done/2")
    half = repeated_lines.open_state(spark, path)
    assert half.version == 1 and rows(repeated_lines.occurrences(repeated_lines.merge(half, chunks.filter("id >= 'c3'")))) == SITE


@pytest.mark.parametrize("parts", [1, 3])
def test_any_number_of_parts_gives_the_same_texts(spark, parts):
    chunks = spark.read.parquet(f"{DATA}/chunks.parquet")
    found = repeated_lines.repeated_lines(chunks, parts=1)
    want = rows(repeated_lines.without_lines(chunks, found))
    assert rows(repeated_lines.cleaned(chunks, parts)) == want
    n = repeated_lines.incremental(chunks, parts).collect()
    assert len(n) == parts and sum(r.n_new for r in n) >= chunks.select("id").distinct().count() and all(r.n_rebuilt >= r.n_new for r in n)


def test_repeated_lines_like_brute_force(spark):
    chunks = spark.read.parquet(f"{DATA}/chunks.parquet")
    keyed = chunks.select("id", "source", "publisher", F.posexplode(repeated_lines.line_keys(F.coalesce("text", F.lit("")))).alias("pos", "key")).distinct().collect()
    sites = {}
    for r in keyed:
        if r.publisher and r.publisher.strip():
            sites[r.source] = r.publisher.strip().lower().removeprefix("www.")
    docs, of = {}, {}
    for r in keyed:
        if r.source in sites:
            docs.setdefault(sites[r.source], set()).add(r.source)
            if r.key:
                of.setdefault((sites[r.source], r.key), set()).add(r.source)
    bad = {k for k, v in of.items() if len(v) >= 5 and len(v) >= len(docs[k[0]]) / 5}
    want = sorted({(r.id, r.pos + 1) for r in keyed if (sites.get(r.source), r.key) in bad}, key=str)
    assert rows(repeated_lines.repeated_lines(chunks)) == want and want


# ---------------------------------------------------------------- scanned text

CLEAN = "The committee reported that modern equipment was installed in several regions, although information about maintenance remained incomplete."


def test_skeleton_survives_misreading():
    for good, bad in (("modern", "modem"), ("second", "sec0nd"), ("time", "tirne"), ("window", "vvindow"), ("united", "uriited"), ("group", "groiip"), ("until", "unt!l"), ("größte", "gr6ßte")):
        assert scan_noise.skeleton(good) == scan_noise.skeleton(bad)
        assert scan_noise.misreading(bad, good)
    assert scan_noise.misreading("cat", "car") is None


@pytest.mark.parametrize("line,certain", [("- 5 -", True), ("[56]", True), ("Seite 3 von 9", True), ("p. 7", True), ("xiv", True), ("| l9", True), ("Pa9e 12", True), ("12/90", True), ("(73.6)", False), ("41.4", False), ("in 2016.", False), ("Reading time: 5", False)])
def test_page_numbers(line, certain):
    assert scan_noise.page_number(line)[0] is certain


def scans(spark):
    body = [
        "Annual Review 2019\nThe committee reported that modern equip-\nment was installed in several regions and low-\ncost financing of infor-",
        "Annual Rev!ew 2019\n\nmation remained incomplcte in several re-\ngions.\n12",
        "Annual Review 2019\nThe committee reported.\n13",
    ]
    lexicon = [CLEAN + " low-cost financing"] * 30
    plans = [("r.pdf", "Annual Review", '{"category": "AI"}', body, "x"), ("r.pdf", "Annual Review", '{"category": "AI"}', body, "x"), ("m.md", None, None, lexicon, "x"), ("n", None, None, [None, ""], "x"), ("o", None, None, None, "x")]
    return spark.createDataFrame(plans, PLAN)


def test_noise(spark):
    got = rows(scan_noise.find_noise(scans(spark), empty(spark, CHUNK)))
    assert got == sorted(
        [
            ("r.pdf", 1, 1, "header"), ("r.pdf", 2, 1, "header"), ("r.pdf", 3, 1, "header"),
            ("r.pdf", 1, 2, "hyphen"), ("r.pdf", 1, 4, "hyphen"), ("r.pdf", 2, 3, "hyphen"), ("r.pdf", 2, 3, "misread"),
            ("r.pdf", 2, 5, "page_number"), ("r.pdf", 3, 3, "page_number"),
        ], key=str,
    )
    text = " ".join(r.text for r in scan_noise.reflowed(scans(spark), empty(spark, CHUNK)).filter("source = 'r.pdf'").orderBy("paragraph").collect())
    assert "modern equipment was installed in several regions and low-cost financing of information remained incomplete in several regions." in text


LEXICON = {"small": 900, "business": 900, "reading": 900, "document": 900, "small-business": 90, "document-reading": 90, "investment": 900, "the": 9000, "owners": 900, "grew": 900, "old": 900}


def noise_in(text):
    return sorted(scan_noise.lines_of(text, scan_noise.Report(None, None, None), scan_noise.Lexicon(LEXICON, 20_000))[0])


def test_halves_of_compounds_are_read():
    assert noise_in("the old document-\nreadin9 grew the") == [(2, "misread")]
    assert noise_in("the old sma1l-\nbusiness owners grew") == [(1, "misread")]
    assert noise_in("the old small-\nbusiness owners grew") == []
    assert noise_in("the old inves-\ntment grew the") == [(1, "hyphen")]


def test_lines_that_begin_with_a_misread_letter():
    assert noise_in("|nvestment grew the old") == [(1, "misread")]
    assert noise_in("| |nvestment | sma1l |") == []


def test_page_numbers_with_gaps(spark):
    said = "The harvest was good.\nIt rose again."
    plans = [("gap", None, None, [f"{said}\n10", said, f"{said}\n12", said], "pdf"), ("year", None, None, [f"{said}\n407", f"2018\n{said}"], "pdf")]
    chunks = [(f"c{i}", f"{said}\n{n}", "s", i, None, None, None, None, None) for i, n in ((0, 43), (1, 44), (3, 46), (5, 48), (6, 900))]
    got = rows(scan_noise.find_noise(spark.createDataFrame(plans, PLAN), spark.createDataFrame(chunks, CHUNK)))
    assert got == [(f"c{i}", 0, 3, "page_number") for i in (0, 1, 3, 5)] + [("gap", 1, 3, "page_number"), ("gap", 3, 3, "page_number"), ("year", 1, 3, "page_number")]


def test_noise_of_nothing(spark):
    assert scan_noise.find_noise(empty(spark, PLAN), empty(spark, CHUNK)).count() == 0
    blank = spark.createDataFrame([("c", None, "s", 0, None, None, None, None, None), ("d", " \n", None, None, None, None, None, None, None)], CHUNK)
    assert scan_noise.find_noise(empty(spark, PLAN), blank).count() == 0


# ---------------------------------------------------------------- pairs

MESSAGES = "seq bigint, conversation_id string, question string, answer string, defect string"
VERDICTS = "seq bigint, abstention string, answer string"
Q = "How fast did grain storage grow in Norland in 2019?"
TURNS = {
    None: ["Grain storage grew by 4.1% in 2019 [1].", "Velthumark, Halbraland", "7.1% [2]", "- one result of the study [1].\n- another one in 2019.", "| a | b |\n|---|---|\n| 1 | 2 |", "Sorry for the earlier confusion: it was 17.1% in 2012.", f"{Q}\n\nIn addition, the storage of grain rose by 3% because of the harvest.", "See below.\n```\nx = 1\n```"],
    "empty": [None, "", " \n", "...", "[1] [2]", "N/A", "null", "​", "```\n```", "**", "<br>"],
    "refusal": ["I'm sorry, but I can't help with that request.", "Nothing to say here at all.", "I cannot provide this information. Consider asking a specialist."],
    "copy": [Q, Q.upper(), f"**{Q}**", f"You asked: {Q}", f"{Q} {Q}"],
    "truncated": ["The storage of grain grew by 4.1% in 2019. In addition, the standards committee withdrew the", "It rose.\n\n```csv\nNorland;46\nSud;", "It rose in the year.\n\n| A | B | C |\n|---|---|---|\n| Norland | 1"],
    "language": ["Die Lagerung von Getreide ist im Jahr 2019 um 4 Prozent gewachsen, und die Nachfrage aus dem Norden ist auch gestiegen."],
}


@pytest.mark.parametrize("answer", TURNS["empty"])
def test_empty_answers(answer):
    assert pairs.is_empty(answer)
    assert not any(pairs.is_empty(a) for d, answers in TURNS.items() if d != "empty" for a in answers)


def test_measures_of_a_clause():
    words = pairs.Words.of(*np.ones((3, pairs.BUCKETS)))
    c = pairs.read([Q, None, ""], [f"{Q} Other words of its own are here.", "- a\n- b\n-", "```\nx = 1"], words)
    place = {name: i for i, (name, _) in enumerate(pairs.FEATURES)}
    at = lambda name: (c.features[:, place[name]] - pairs._OFFSET[place[name]]).tolist()
    assert c.turn.tolist() == [0, 0, 1, 1, 1, 2, 2] and at("kind") == [0, 0, 1, 1, 1, 4, 3]
    assert at("echo")[0] == 34 and at("echo")[1] == 0 and at("broken block")[-1] == 2 and at("broken block")[1] == 1
    assert all(0 <= v < n for (name, n) in pairs.FEATURES for v in at(name))
    assert pairs.read([], [], words).features.shape == (0, len(pairs.FEATURES))


def test_field_like_brute_force():
    """Viterbi against every sequence of tags, for turns of different length at once."""
    rng = np.random.default_rng(3)
    field = pairs.Field(rng.normal(size=(pairs.N_FEATURES, 5)), rng.normal(size=(5, 5)))
    turn = np.array([0, 0, 0, 1, 2, 2, 2, 2, 3, 3])
    c = pairs.Clauses(turn, np.ones(10), rng.integers(0, pairs.N_FEATURES, (10, len(pairs.FEATURES))))
    got = field.tags(c)
    for t in range(4):
        own = np.flatnonzero(turn == t)
        s = field.weights[c.features[own]].sum(axis=1)
        best = max(itertools.product(range(5), repeat=len(own)), key=lambda y: sum(s[i, k] for i, k in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
        assert got[own].tolist() == list(best)


def messages_of(*names):
    return [pd.read_parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in names]


@pytest.fixture(scope="module")
def field(spark):
    d = "/root/testdata/sf0.1"
    return pairs.trained(spark.read.parquet(f"{d}/messages.parquet"), spark.read.parquet(f"{d}/verdicts.parquet"))


def test_cuts_are_never_at_ends():
    rng = np.random.default_rng(1)
    text = "It rose by 3%. It fell again.\n- one item\n- another item\n\n| a | b |\n|---|---|\n| 1 | 2 |"
    ends = {text, "It rose by 3%.", "It rose by 3%. It fell again."}
    for _ in range(300):
        cut = pairs._cut(text, rng)
        assert cut is None or (text.startswith(cut) and cut not in ends and text[len(cut) :].lstrip(" ")[:1] not in ("", "\n"))


def test_defects_by_a_field_trained_on_made_defects(field):
    """The field has seen no broken answer of the tables as one; its refusals are none of the abstentions it has seen."""
    turns = [(d, a) for d, answers in TURNS.items() for a in answers if a != "Nothing to say here at all."]
    got, share = pairs.defects(*field, [Q] * len(turns), [a for _, a in turns])
    assert [(d, a) for (d, a), g in zip(turns, got) if d != g] == []
    assert np.allclose(share.sum(axis=1)[[d != "empty" for d, _ in turns]], 1)
    asked, _ = pairs.defects(*field, [Q + " Answer in German.", None], [TURNS["language"][0], "The storage of grain grew."])
    assert asked == [None, None]


def test_the_field_learns_from_what_was_made(field):
    """Held-out turns with made defects; and without made cuts and abstentions it knows neither."""
    m, v = messages_of("messages", "verdicts")
    m = m[["question", "answer"]].dropna().drop_duplicates().sort_values(["question", "answer"]).sample(1500, random_state=7)
    told = sorted(v["abstention"].dropna().unique())
    q, a, tags = pairs.labelled(list(m.itertuples(index=False, name=None)), told, seed=5)
    c, gold = pairs.read(q, a, field[1]), np.concatenate(tags)
    assert (field[0].tags(c) == gold).mean() >= 0.97
    known = [i for i, t in enumerate(tags) if not {pairs.REFUSAL, pairs.UNFINISHED} & set(t)]
    less = pairs.Field.train(pairs.read([q[i] for i in known], [a[i] for i in known], field[1]), np.concatenate([tags[i] for i in known]), rounds=30)
    assert not np.isin(less.tags(c), (pairs.REFUSAL, pairs.UNFINISHED)).any()


def test_bad_pairs(spark):
    data = [(1, "c", Q, None, "clash"), (2, "c", Q, " ", "clash"), (2, "c", Q, " ", "clash"), (3, "c", None, None, None)]
    v = [(1, None, "clash"), (2, "Nothing to say here at all.", "")]
    assert rows(pairs.bad_pairs(spark.createDataFrame(data, MESSAGES), spark.createDataFrame(v, VERDICTS))) == [(1, "empty"), (2, "empty"), (3, "empty")]
    assert pairs.bad_pairs(empty(spark, MESSAGES), empty(spark, VERDICTS)).count() == 0


# ---------------------------------------------------------------- harm

DOCS = "doc_id bigint, text string, source string, abusive string"
LABELS = "doc_id bigint, label string, source string"


def told(text):
    p = harm.passages([text])
    return [p.told(i) for i in range(len(p.begin))]


def test_disguises_fold():
    for bad in ("filthy idiot", "FILTHY IDIOT!!", "fillllthy i d i o t", "f​ilthy idіot", "f1lthy 1d10t", "fílthy idiot"):
        assert told(bad) == ["filthy idiot"], bad
    assert told("One two. Three four; five six!\nSeven <b>eight nine</b>\n\n") == ["one two", "three four", "five six", "seven", "eight nine"]
    assert told("The first clause of all is here, and the second one follows it, then comes a third") == [
        "the first clause of all is here and the second one follows it then comes a third", "the first clause of all is here", "and the second one follows it",
        "the first clause of all is here and the second one follows it", "and the second one follows it then comes a third",
    ]
    assert told(None) == told("") == told(" \n") == told("☃ .,;") == []


def test_passages_keep_to_their_texts():
    texts = ["a first text", None, "second one, with some clauses, of its own. And more", "", "x" * 5000, "last"]
    p = harm.passages(texts)
    for i, t in enumerate(texts):
        assert [p.told(j) for j in np.flatnonzero(p.text == i)] == told(t)
    h, values = harm.hashes(p.code), np.random.default_rng(1).random(harm.SIZE)
    g, o = harm._grams(p, h, np.arange(len(p.begin)))
    assert np.allclose(harm._sums(p, h, values), np.bincount(o, weights=values[g], minlength=len(p.begin)))
    assert np.array_equal(harm._number(p), np.bincount(o, minlength=len(p.begin)))


INSULTS, SLURS, LURES = ("{} is a pathetic idiot and a worthless loser", "shut up you worthless idiot from {}"), ("foreigners in {} are parasites and should be driven out", "all foreigners in {} are born thieves and parasites"), ("send nude pictures to {} and have hardcore sex tonight", "nude girls in {} want hardcore sex tonight")
CALM = ("The harvest in {} was good.", "Analysts in {} expect a further rise, although demand fell.", "Rats and parasites destroyed the stocks in {}.", "Could you add {} next time?")
PLACES = [a + b for a in ("Nor", "Zar", "Wyn", "Kes", "Tor", "Ald") for b in ("land", "vale", "mark", "holm", "stad")]


def labelled():
    out = []
    for i, place in enumerate(PLACES):
        calm = " ".join(c.format(place) for c in CALM)
        out.append((f"{calm} {calm.upper()}", "none"))
        for kind, lines in zip(harm.KINDS, (INSULTS, SLURS, LURES)):
            if i % 3 == 0:
                out.append((f"{calm} {lines[i % 2].format(place)}.", kind))
    return out + [(CALM[0].format(PLACES[1]), "hateful"), (f"{CALM[3].format(PLACES[1])} {SLURS[0].format(PLACES[1])}", "none")]


def test_harm(spark):
    lines = [INSULTS[0].format("Aldria"), CALM[2].format("Aldria"), SLURS[1].format("Aldria"), LURES[1].format("Aldria")]
    docs = [(i, t, "train", "") for i, (t, _) in enumerate(labelled())]
    new = [(1001 + i, f"{CALM[1].format('Aldria')} {x}.", "a" if i < 2 else "b", "") for i, x in enumerate(lines)] + [(1005, None, "b", ""), (1006, "", "b", ""), (1007, "```\n|---|", None, ""), (1008, "the harvest " * 10_000, "b", "")]
    labels = [(i, k, "") for i, (_, k) in enumerate(labelled())] + [(1002, "none", ""), (1002, None, ""), (99_999, "abusive", ""), (1001, "none", ""), (1001, "sexual", "")]
    d, labels = spark.createDataFrame(docs + new, DOCS), spark.createDataFrame(labels + labels[:3], LABELS)
    scores = harm.score_documents(d, labels)
    assert rows(harm.found(scores).filter("doc_id > 1000")) == [(1001, "abusive"), (1003, "hateful"), (1004, "sexual")]
    # The wrong labels of both kinds are seen through.
    wrong = {r.doc_id: r.harm for r in harm.found(scores).collect() if r.doc_id in (len(docs) - 1, len(docs) - 2)}
    assert wrong == {len(docs) - 1: "hateful"}
    assert scores.count() == len(docs) + len(new)
    assert {r.source: (r.n_documents, r.hateful_rate) for r in harm.rates(scores).collect() if r.source != "train"} == {"a": (2, 0.0), "b": (5, 0.2), None: (1, 0.0)}
    assert harm.score_documents(d.limit(0), labels).count() == 0


def test_without_labels_nothing_is_known(spark):
    d = spark.createDataFrame([(1, INSULTS[0].format("x"), "a", "")], DOCS)
    assert rows(harm.score_documents(d, empty(spark, LABELS)).drop("source")) == [(1, 0.0, 0.0, 0.0)]
    only = harm.train([(t, k) for t, k in labelled() if k in ("none", "sexual")])
    assert only.score([INSULTS[0].format("Aldria"), LURES[0].format("Aldria")]).round().tolist() == [[0, 0, 0], [0, 0, 1]]


def test_held_out_accuracy():
    """Trained on the labels of one half of the documents, held against those of the other half, some of which are wrong."""
    root, recall = ("/root/testdata/check_l", 0.85) if os.path.exists("/root/testdata/check_l") else ("/root/testdata/sf0.1", 0.35)
    read = lambda name, columns: pd.read_parquet(f"{root}/{name}.parquet", columns=columns)
    labels = read("labels", ["doc_id", "label"]).dropna().drop_duplicates()
    data = labels[~labels["doc_id"].duplicated(keep=False)].merge(read("documents", ["doc_id", "text"]), on="doc_id").dropna()
    half = data["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 2 == 0)
    model = harm.train(list(data[half].sort_values("doc_id")[["text", "label"]].itertuples(index=False, name=None)))
    score = model.score(data[~half]["text"].tolist())
    label = data[~half]["label"].to_numpy()
    flagged, said = score.max(axis=1) >= harm.THRESHOLD, label != "none"
    right = sum(label[i] == harm.KINDS[score[i].argmax()] for i in np.flatnonzero(flagged))
    assert right / flagged.sum() >= 0.9
    assert (flagged & said).sum() / said.sum() >= recall
    assert (flagged & ~said).sum() <= 0.005 * (~said).sum()


# ---------------------------------------------------------------- queries


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_null_keys(spark):
    text = "The committee reported that modern equip-\nment was installed in several regions."
    chunks = spark.createDataFrame([("a", text, None, None, None, None, None, None, None), (None, text, "s", 1, "x.org", "{bad", None, None, None), ("b", text, "s", None, "x.org", None, None, None, None), ("c", "word " * 700, "s", None, None, None, None, None, None)], CHUNK)
    plans = spark.createDataFrame([(None, None, None, [text, None], None), ("p", None, "null", None, None)], PLAN)
    assert {(r.item, r.page_no, r.noise) for r in scan_noise.find_noise(plans, chunks).collect()} == {(None, 1, "hyphen"), ("a", 0, "hyphen"), (None, 0, "hyphen"), ("b", 0, "hyphen")}
    assert scan_noise.reflowed(plans, chunks).count() >= 1
    assert rows(splitting.oversized(items(plans, chunks))) == [("chunk", "c", 0)]
    assert repeated_lines.repeated_lines(chunks).count() == 0
    docs = spark.createDataFrame([(None, "shut up, you filthy idiot", None, None), (1, "fine", "a", None), (1, "fine", "a", None)], DOCS)
    model = harm.train(labelled())
    named = docs.unionByName(spark.createDataFrame([(None, INSULTS[0].format("Aldria"), None, None)], DOCS))
    assert {r.doc_id for r in harm.found(harm.score_by(named, model)).collect()} == {None}
    assert encoding.encode_corpus(docs).count() == 3 and packing.pack_documents(docs).count() == 3
    m = spark.createDataFrame([(None, None, "Why?", "", None), (2, None, "Why?", "", None)], MESSAGES)
    assert rows(pairs.bad_pairs(m, empty(spark, VERDICTS))) == [(2, "empty"), (None, "empty")]
