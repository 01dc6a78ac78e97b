"""The corpus pipeline against brute force, stage by stage, and the operators on hard rows."""

import random
import re

import pytest

import corpus_pipeline
from fusewright.llm import decontaminate, fingerprint, html, jaccard, language, repeats, suffixes, tokens, toxicity

ENGLISH = "the of and to in is that it was for on are with as his they be at one have this from or had by but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split()
GERMAN = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine seiner worden will zwischen im immer".split()


def rows():
    rnd = random.Random(7)
    say = lambda words, n: " ".join(rnd.choice(words) for _ in range(n))
    plain = [(say(ENGLISH, rnd.randint(30, 90)), "en") if i % 2 else (say(GERMAN, rnd.randint(30, 90)), "de") for i in range(60)]
    near = plain[3][0].split()
    near[-1] = "changed"
    passage = say(ENGLISH, 40)
    plain += [(plain[1][0], "en"), (" ".join(near), "en"), (say(ENGLISH, 30) + " " + passage, "en"), (say(ENGLISH, 35) + " " + passage + " end", "en")]
    leaked = say(ENGLISH, 14)
    plain += [(say(ENGLISH, 40) + " " + leaked + " " + say(ENGLISH, 20), "en"), (None, None), ("", "en"), ("12 34 !", None)]
    return [(i, t, lang, "web", len(t or ""), i, "clash") for i, (t, lang) in enumerate(plain)], leaked


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    docs, leaked = rows()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, leaked), (2, "absent"), (3, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def windows(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def groups(texts, n, percent):
    sets = {i: set(windows(t.lower().split(), n)) or ({tuple(t.lower().split())} if t.split() else set()) for i, t in texts.items()}
    least = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
    return least


def without_repeats(texts, n):
    seen, out = set(), {}
    for i in sorted(texts):
        words = texts[i].split()
        gone = set()
        for at, w in enumerate(windows(words, n)):
            if w in seen:
                gone |= set(range(at, at + n))
            seen.add(w)
        if len(gone) < len(words):
            out[i] = " ".join(w for k, w in enumerate(words) if k not in gone)
    return out


def test_stages_against_brute_force(spark, folder):
    docs, leaked = rows()
    source = {r[0]: r[1] for r in docs}
    now, names = spark.read.parquet(f"{folder}/documents.parquet"), None
    names = now.columns
    want: dict = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/stage{k}")
        now = spark.read.parquet(f"{folder}/stage{k}")
        if name == "language_id":
            want = {r.doc_id: r.text for r in now.collect()}
            assert {i for i, t in source.items() if not re.search("[a-z]", t or "")}.isdisjoint(want)
            assert all(want[i] == source[i] for i in want) and {*range(60)} <= {*want}
        elif name == "near_duplicates":
            least = groups(want, 5, 80)
            want = {i: t for i, t in want.items() if least[i] == i}
            assert 60 not in want and 61 not in want
        elif name == "substring_dedup":
            before, want = want, without_repeats(want, 20)
            assert len(want[63]) < len(before[63])
        elif name == "decontamination":
            items = {*windows(leaked.split(), 10), ("absent",)}
            want = {i: t for i, t in want.items() if not any(w in items for n in (1, 10) for w in windows(t.lower().split(), n))}
            assert 64 not in want
        if k < 4:
            assert now.columns == names
            assert {r.doc_id: r.text for r in now.collect()} == want and now.count() == len(want)
            assert all(r.n_chars == len(r.text) and r.kept == "clash" for r in now.where("doc_id < 60").collect())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    packed = {i: 0 for i in want}
    for r in now.collect():
        assert r.start == packed[r.doc_id] and r.offset + r.length <= 4096
        packed[r.doc_id] += r.length
    assert packed == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in want.items()}
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, now.collect()))


#: Null keys, repeated rows, ties, an empty and a very long text, and columns named as the operators' own.
HARD = "doc_id long, text string, n_words string, kept string, lang string, score string, items string, fingerprint string, start string"
LONG = " ".join(f"w{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def hard(spark):
    t = [(1, "some words in a row"), (1, "some words in a row"), (2, "some words in a row"), (3, None), (4, ""), (5, LONG), (None, "a text without id"), (None, None)]
    return spark.createDataFrame([(*x, *"abcdefg") for x in t], HARD).repartition(3)


@pytest.fixture(scope="module")
def learned(spark):
    text = lambda i: f"the cat and the dog {i}" if i % 2 else f"der hund und die katze {i}"
    d = spark.createDataFrame([(i, text(i), "en" if i % 2 else "de") for i in range(80)], "doc_id long, text string, lang string")
    return language.fit(d), toxicity.fit(d, d.selectExpr("doc_id", "int(doc_id % 2) as toxic"))


#: What each operator gives for a row of HARD, by (doc_id, text): of its own columns those named.
HARD_VALUES = {
    "language": (["lang_pred", "rejected"], lambda i, t: ("und", True) if not t else None),
    "toxicity": (["score", "predicted"], lambda i, t: None),  # null and empty texts: the base score
    "decontaminate": (["n_words", "n_hit", "items"], lambda i, t: (len((t or "").split()), 5 if i in (1, 2) else 0, ["1"] if i in (1, 2) else [])),
    "repeats": (["n_words", "n_removed", "kept"], lambda i, t: (len((t or "").split()), 0, t)),
    "suffixes": (["n_bytes", "n_removed", "n_spans", "kept"], lambda i, t: (len(t or ""), 0, 0, (t or "").encode())),
    "jaccard": (["n_shingles", "component_id"], lambda i, t: (max(0, len((t or "").split()) - 3), 1 if i == 2 else i)),
    "fingerprint": (["n_chars"], lambda i, t: (len(t or ""),)),
    "token_counts": (["section", "start", "end"], lambda i, t: ("0", 0, len(t or ""))),
    "pack": (["piece", "start"], lambda i, t: (0, 0) if i != 5 else None),
}


@pytest.mark.parametrize("name", [*HARD_VALUES])
def test_hard_rows(spark, hard, learned, name):
    items = spark.createDataFrame([(1, "some words in a row"), (None, None)], "item_id long, text string")
    run = {
        "language": lambda d: language.identify(d, learned[0]),
        "toxicity": lambda d: toxicity.score(d, learned[1]),
        "decontaminate": lambda d: decontaminate.phrase_matches(d, items),
        "repeats": lambda d: repeats.substring_dedup(d),
        "suffixes": lambda d: suffixes.suffix_dedup(d),
        "jaccard": lambda d: jaccard.jaccard_components(d, 4, 85),
        "fingerprint": lambda d: fingerprint.compare_edits(d),
        "token_counts": lambda d: tokens.attribute_tokens(d),
        "pack": lambda d: tokens.pack(d),
    }[name]
    columns, want = HARD_VALUES[name]
    text = {1: "some words in a row", 2: "some words in a row", 3: None, 4: "", 5: LONG}
    found = run(hard).collect()
    ids = [r.doc_id for r in found if r.doc_id is not None]
    assert {*ids} == {*text} and (name == "pack" or ids.count(1) == 2)
    bare = lambda v: bytes(v) if isinstance(v, bytearray) else [*v] if isinstance(v, list) else v
    for r in found:
        values = want(r.doc_id, text.get(r.doc_id))
        if r.doc_id is not None and values is not None:
            assert tuple(bare(r[c]) for c in columns) == values, r.doc_id
    # Rows with one text get one result; other columns pass, but for those that an operator replaces or leaves out.
    one, two = ([tuple(bare(r[c]) for c in columns) for r in found if r.doc_id == i] for i in (1, 2))
    assert name in ("jaccard", "pack") or {*map(str, one)} == {*map(str, two)}
    kept = [c for c in hard.columns if c in found[0].__fields__ and c not in (*columns, "doc_id", "text", "lang", "score", "items", "fingerprint", "start", "kept", "n_words")]
    assert all(r[c] in "abcdefg" for r in found for c in kept)
    empty = run(hard.limit(0))
    assert empty.count() == 0 and empty.columns == run(hard).columns


def test_fits_without_rows(spark):
    """Models learned from nothing say so."""
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    some = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert {(r.lang_pred, r.rejected) for r in language.identify(some, language.fit(none)).collect()} == {("und", True)}
    model = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(some, model).collect()} == {0}


def test_rows_with_one_id_or_none_are_kept(spark, folder):
    """The pipeline's stages lose no row for its id: rows that share one, and rows without."""
    words = lambda s: " ".join(f"{s}{i}" for i in range(30))
    rows = [(1, words("a"), "en"), (1, words("b"), "en"), (None, words("c"), "en"), (None, words("c"), "en"), (2, words("a"), "en"), (3, words("d"), "en"), (1, words("a"), "en")]
    docs = spark.createDataFrame([(i, t, lang, "web", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    # Of the three rows with the text a document 2 has an id of its own; of the two without id one stays.
    assert sorted((r.doc_id is None, r.doc_id, r.text[0]) for r in kept.collect() if r.doc_id is not None) == [(False, 1, "b"), (False, 2, "a"), (False, 3, "d")]
    assert kept.where("doc_id is null").count() == 1 and kept.columns == docs.columns


def test_a_run_deletes_only_its_own_tables(spark, folder):
    """Frames of an operator, and of a run before, can still be read after another run of the pipeline."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mine = repeats.substring_dedup(docs)
    n = mine.count()
    before = corpus_pipeline.run(spark, folder)
    m = before.count()
    corpus_pipeline.run(spark, folder)
    assert len(mine.collect()) == n and len(before.collect()) == m


def test_hard_pages(spark):
    d = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "", "x"), (None, None, "<p>one</p>", "x"), (4, "u", "<p>" + "long " * 50_000, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(d).collect()}
    assert got[1].text == got[2].text == "" and got[4].n_chars == 249_999 and len(got) == 4


def test_language_floor_at_every_length(spark):
    rnd = random.Random(3)
    say = lambda words, n: " ".join(rnd.choice(words) for _ in range(n))
    model = language.fit(spark.createDataFrame([(i, say(GERMAN if i % 2 else ENGLISH, rnd.randint(20, 90)), "de" if i % 2 else "en") for i in range(100)], "doc_id long, text string, lang string"))
    kinds = {"letters": "abcdefghijklmnopqrstuvwxyz", "base64": "".join(map(chr, [*range(65, 91), *range(97, 123), *range(48, 58), 43, 47])), "cyrillic": "".join(map(chr, range(0x430, 0x450)))}
    junk = [(kind, n, "".join(rnd.choices(letters, k=n))) for kind, letters in kinds.items() for n in (50, 500, 5_000, 20_000, 200_000)]
    good = [(k, n, say(w, n)) for k, w in (("en", ENGLISH), ("de", GERMAN)) for n in (10, 100, 1_000, 40_000)] + [("en", 0, (say(ENGLISH, 12) + "\n") * 2_000)]
    found = language.identify(spark.createDataFrame([*junk, *good], "kind string, n int, text string"), model).collect()
    assert [(r.kind, r.n) for r in found if r.rejected] == [(k, n) for k, n, _ in junk]
    assert all(r.kind == r.lang_pred for r in found if not r.rejected)


def test_all_languages_are_learned(spark):
    rnd = random.Random(5)
    words = {f"x{k:02d}": ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(70)}
    docs = [(f"{x}.{i}", " ".join(rnd.choices(w, k=30)), x) for x, w in words.items() for i in range(3 if x == "x69" else 4)]
    model = language.fit(spark.createDataFrame(docs, "doc_id string, text string, lang string"))
    assert {*model.languages} == {*words}
    unseen = [(x, " ".join(rnd.choices(w, k=30))) for x, w in words.items()]
    found = language.identify(spark.createDataFrame(unseen, "own string, text string"), model).collect()
    assert all(r.lang_pred == r.own and not r.rejected for r in found)
