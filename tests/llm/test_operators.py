"""The training-data operators against brute force, on small tables with hard rows."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from fusewright.llm import common as C
from fusewright.llm import decontaminate, fingerprint, html, jaccard, language, repeats, suffixes, tokens, toxicity

BASE = "the quick brown fox jumps over the lazy dog while nine old wizards quietly mix seven jars of very fine amber honey today before noon comes again"
TEXTS = [BASE, BASE, None, "", " \n ", BASE + " and more", "one", "word " * 300, "é" * 150 + BASE, BASE.upper(), "x" + BASE[40:] + BASE[:90]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, kept string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def covered(units, k):
    seen, gone = set(), {}
    for i, u in units:
        flags = [False] * len(u)
        for j in range(len(u) - k + 1):
            w = bytes(u[j : j + k]) if isinstance(u, bytes) else tuple(u[j : j + k])
            if w in seen:
                flags[j : j + k] = [True] * k
            seen.add(w)
        gone[i] = flags
    return gone


def test_substring_dedup(docs, none):
    want = covered([(i, (t or "").encode().split()) for i, t in enumerate(TEXTS)], 20)
    for r in repeats.substring_dedup(docs).collect():
        words = (TEXTS[r.doc_id] or "").split()
        assert (r.n_words, r.n_removed) == (len(words), sum(want[r.doc_id]))
        assert (r.kept or "") == " ".join(w for w, g in zip(words, want[r.doc_id], strict=True) if not g)
    assert repeats.substring_dedup(none).count() == 0


def test_suffix_dedup(docs, none):
    want = covered([(i, (t or "").encode()) for i, t in enumerate(TEXTS)], 100)
    for r in suffixes.suffix_dedup(docs).collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        assert bytes(r.kept) == bytes(b for b, g in zip(raw, want[r.doc_id], strict=True) if not g)
        assert r.n_removed == sum(want[r.doc_id])
    assert suffixes.suffix_dedup(none).count() == 0


def hard_texts():
    """Pieces of few kinds in many orders, runs without a trigger, and texts of one letter."""
    rnd = random.Random(4)
    pieces = ["".join(rnd.choices("abcd é\n", k=rnd.randint(5, 160))) for _ in range(12)]
    texts = ["".join(rnd.choices(pieces, k=rnd.randint(1, 9))) for _ in range(60)]
    return [*texts, "a" * 700, "b" + "a" * 350, "ab" * 300, "x" * 99, "x" * 100, "x" * 101]


@pytest.mark.parametrize("most", [1 << 19, 3])
def test_suffix_dedup_by_brute_force(spark, most):
    texts = hard_texts()
    want = covered([(i, t.encode()) for i, t in enumerate(texts)], 100)
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(5)
    for r in suffixes.suffix_dedup(rows, bucket_phrases=most).collect():
        raw, gone = texts[r.doc_id].encode(), want[r.doc_id]
        assert bytes(r.kept) == bytes(b for b, g in zip(raw, gone, strict=True) if not g), r.doc_id
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)))


@pytest.mark.parametrize("most", [1 << 21, 3])
def test_substring_dedup_by_brute_force(spark, most):
    rnd = random.Random(6)
    pieces = [" ".join(rnd.choices("abcde", k=rnd.randint(3, 30))) for _ in range(12)]
    texts = [" ".join(rnd.choices(pieces, k=rnd.randint(1, 9))) for _ in range(60)] + ["w " * 200, "w " * 30]
    want = covered([(i, t.encode().split()) for i, t in enumerate(texts)], 20)
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(5)
    with_few = repeats.substring_dedup(rows, bucket_windows=most).collect()
    for r in with_few:
        words = texts[r.doc_id].split()
        assert (r.kept, r.n_removed) == (" ".join(w for w, g in zip(words, want[r.doc_id], strict=True) if not g), sum(want[r.doc_id]))
    assert len(with_few) == len(texts)


def test_rows_that_share_an_id(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    t = [(1, "first " + passage), (1, passage + " second"), (1, "first " + passage), (2, passage), (None, passage), (None, passage)]
    rows = spark.createDataFrame([(i, x, "own", 1, 2, 3, b"b") for i, x in t], "doc_id long, text string, spans string, hit_ int, key_ int, c0 int, blob binary")
    for run in (lambda d: repeats.substring_dedup(d), lambda d: suffixes.suffix_dedup(d)):
        got = run(rows).collect()
        assert len(got) == 6 and all((r.spans, r.hit_, r.key_, r.c0, bytes(r.blob)) == ("own", 1, 2, 3, b"b") for r in got)
        lost = sorted((r.doc_id is None, r.doc_id, r.text.split()[0], r.n_removed > 0) for r in got if r.doc_id is not None)
        # Of the texts of document 1 one keeps the passage, in both of its repeated rows if it is that one; 2 loses it.
        assert sorted(x[3] for x in lost if x[1] == 1) in ([False, False, True], [False, True, True]) and lost[-1][3]
        assert not any(r.n_removed for r in got if r.doc_id is None)


def test_jaccard(docs, none):
    def shingles(t):
        w = re.findall(r"[^ \t-\r]+", (t or "").lower()) if t is None or t.isascii() else [x.lower() for x in t.split()]
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in TEXTS]
    comp = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 4, 85).collect()}
    assert got == {i: (len(s), comp[i]) for i, s in enumerate(sets)}
    assert jaccard.jaccard_components(none).count() == 0


@pytest.mark.parametrize("long", [512, 2])
def test_jaccard_of_groups_of_copies(spark, monkeypatch, long):
    """Large groups of near copies, and sets between them, with long lists in parts and whole."""
    monkeypatch.setattr(jaccard, "LONG", long)
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(60)]
    bases = [rnd.sample(words, 40) for _ in range(3)]
    bases.append(bases[0][:20] + bases[1][20:])  # half of either: linked with neither
    texts = []
    for b in bases:
        for k in range(14):
            t = b[:]
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(40)] = f"x{rnd.randrange(5)}"
            texts.append(" ".join(t[: 40 - k % 3]))
    texts += [" ".join(bases[0][:12]), " ".join(bases[1][5:25]), "lone words here now and then"]

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)}

    sets = [shingles(t) for t in texts]
    comp = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 70 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(rows, 2, 70).collect()}
    assert got == dict(enumerate(comp)) and 4 < len({*comp}) < len(comp)


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, BASE[:80]), (2, "One"), (3, None), (4, "absent words here")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.phrase_matches(docs, items).collect()}
    assert list(got[0]["items"]) == ["1"] and list(got[6]["items"]) == ["2"] and got[9].n_hit == got[0].n_hit > 0
    assert got[2].n_words == 0 and not got[7].n_hit
    assert decontaminate.proximity_matches(docs, items).where("doc_id = 0").count() > 0


def test_proximity_on_edited_passages(spark):
    rnd = random.Random(11)
    common = [f"w{i}" for i in range(40)]
    passage = [*rnd.sample(common, 5), "rareone", *rnd.sample(common, 4), "raretwo", *rnd.sample(common, 3)]
    texts = [rnd.choices(common, k=90) for _ in range(12)]
    for i, edit in enumerate((lambda p: p, lambda p: [w if w != "rareone" else "other" for w in p], lambda p: [*p[:3], "new", "more", *p[3:]], lambda p: p[:4] + p[6:], lambda p: ["x", "y", "z", *p[3:]], lambda p: p[::-1])):
        at = (0, 40, 58, 76, 20, 60)[i]
        texts[i][at:at] = edit(passage)
    texts += [["word"] * 70, [], passage[:9], ["rareone", "a", "raretwo"]]
    items = {"1": passage, "2": ["nowhere", *texts[7][10:19]], "3": texts[8][5:11], "4": ["w1"], "5": ["nowhere", "never", "no", *texts[7][40:47]], "6": [], "7": texts[9][60:75]}
    want = {}
    for name, words in items.items():
        for k in range(max(len(words) - 9, min(len(words), 1))):
            w = words[k : k + 10]
            for d, t in enumerate(texts):
                n, s = max(((sum(x in t[max(0, s + o - 3) : max(0, s + o + 4)] for o, x in enumerate(w)), -s) for s in range(-13, len(t) + 4)), default=(0, 0))
                if n >= len(w) - 2 * len(w) // 10:
                    want.setdefault((d, tuple(w)), (-s, n, []))[2].append(name)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(0, " ".join(texts[0])), (None, " ".join(passage)), (99, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(int(k), " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = {(r.doc_id, tuple(r.window)): (r.start, r.n_found, list(r["items"])) for r in decontaminate.proximity_matches(docs, bench).collect()}
    assert got == want and {d for d, w in want if "rareone" in w} >= {0, 1, 2, 3} and any(w[0] == "nowhere" for _, w in want)
    near = {}
    for (d, _), (_, _, ids) in want.items():
        near.setdefault(d, []).append(ids)
    rows = decontaminate.near_matches(docs, bench).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        own = near.get(r.doc_id, [])
        assert (r.n_near, list(r.near_items)) == (len(own), sorted({x for ids in own for x in ids}))


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    rows = tokens.pack(docs, size=64, with_ids=True).collect()
    whole: dict = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        whole[r.doc_id] = whole.get(r.doc_id, b"") + bytes(r.ids)
    for i, x in enumerate(TEXTS):
        assert whole[i] == b"".join(n.to_bytes(4, "little") for n in [*t.encode(x or "", add_special_tokens=False).ids, 1])
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64
    assert tokens.pack(none).count() == 0


def test_token_counts(spark, docs, none):
    """Against whole documents through the tokenizers library, token by token."""
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokens.vocabulary_path())
    rnd = random.Random(8)
    odd = ["e\u0301te\u0301 co-op U.S.A. 3.14, x_y", "日本語 and text\n\n\nend\n", "Tabs\tand\r\nfeeds\x0b\x0c.", "<b>mark-up</b> & co.", "I\u0307stanbul SS\u1e9e"]
    texts = [*TEXTS, *odd, *("".join(rnd.choices("ab.,'-_ \n1Zé", k=rnd.randint(1, 120))) for _ in range(60))]

    def cuts(text):
        n = len(text)
        at = sorted({rnd.randint(0, n) for _ in range(6)})
        return [(f"s{i}", x, y) for i, (x, y) in enumerate(zip(at, at[1:], strict=False)) if i != 2] + [("beyond", n + 5, n + 9)]

    given = [cuts(t or "") for t in texts]
    lines = []
    for t in texts:
        parts, at = [], 0
        for x in (t or "").split("\n"):
            parts.append((at, min(at + len(x) + 1, len(t or ""))))
            at += len(x) + 1
        lines.append([(str(i), x, y) for i, (x, y) in enumerate(parts) if x < y or i == 0])

    def attributed(text, sections):
        found = {k: [0, 0] for k, _, _ in sections}
        spans = encoder.encode(text or "", add_special_tokens=False).offsets
        for x, y in spans:
            over = [(min(y, e, len(text)) - max(x, s), -i, k) for i, (k, s, e) in enumerate(sections) if min(y, e, len(text)) > max(x, s)]
            if over:
                found[max(over)[2]][0] += 1
                found[max(over)[2]][1] += len(over) > 1
        return {k: (*v, len(spans)) for k, v in found.items()}

    kind = "doc_id long, text string, own array<struct<section:string,start:int,end:int>>"
    rows = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, given, strict=True))] + [(999, "no sections", None)], kind)
    crossed = 0
    for sections, want in ((None, [*lines]), ("own", given)):
        got: dict = {}
        for r in tokens.attribute_tokens(rows, sections).collect():
            got.setdefault(r.doc_id, {})[r.section] = (r.n_tokens, r.n_crossing, r.doc_tokens)
        assert (999 in got) == (sections is None)
        for i, t in enumerate(texts):
            assert got.get(i, {}) == attributed(t, want[i]), (i, t)
            crossed += sum(x[1] for x in got[i].values())
    assert crossed > 20 and tokens.attribute_tokens(none).count() == 0


def test_other_vocabularies_are_encoded_whole(tmp_path):
    """A vocabulary whose words cross white space gives the library's own ids."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = {x: i for i, x in enumerate(["[U]", "a b", "a", "b", " "])}
    t = Tokenizer(models.WordLevel(words, unk_token="[U]"))
    t.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
    t.save(path := str(tmp_path / "own.json"))
    texts = ["a b\na", "", "b\nA"]
    for spans in (False, True):
        out = tokens.encode(*C.utf8(pa.array(texts, pa.large_string())), path, spans)
        want = [t.encode(x) for x in texts]
        assert out[0].tolist() == [i for e in want for i in e.ids] and out[1].tolist() == [0, 2, 2, 4]
        if spans:
            assert [*zip(out[2].tolist(), out[3].tolist(), strict=True)] == [o for e in want for o in e.offsets]


def test_slots_are_those_of_best_fit():
    """The histogram's plan takes as many sequences as best fit, one piece after the other, longest first."""
    rnd = random.Random(3)
    for size, n in ((10, 40), (64, 300), (100, 1000)):
        for _ in range(20):
            lengths = [min(size, max(1, int(rnd.expovariate(4 / size)))) for _ in range(n)]
            room: list[int] = []
            for x in sorted(lengths, reverse=True):
                fits = [r for r in room if r >= x]
                if fits:
                    room.remove(min(fits))
                room.append((min(fits) if fits else size) - x)
            runs, used = tokens.plan_slots(dict(Counter(lengths)), size)
            assert used == len(room)
            filled: dict = {}
            for length, lo, hi, base, each, offset in runs.tolist():
                for r in range(hi - lo):
                    filled.setdefault(base + r // each, []).append((offset + r % each * length, length))
            assert sum(map(len, filled.values())) == n
            for own in filled.values():
                at = 0
                for o, x in sorted(own):
                    assert o == at
                    at += x
                assert at <= size


def test_fingerprints(docs, none):
    got = {r.doc_id: r for r in fingerprint.compare_edits(docs).collect()}
    order = sorted(got, reverse=True)
    for k, i in enumerate(order):
        x, y = TEXTS[i] or "", TEXTS[order[(k + 1) % len(order)]] or ""
        assert got[i].edited == x[: len(x) - len(x) // 3] + y[: len(x) // 3]
        assert 0 <= got[i].near_edited <= 1
    assert got[0].fingerprint == got[1].fingerprint != got[5].fingerprint and got[1].near_next == 1
    assert fingerprint.compare_edits(none).count() == 0


def test_fingerprints_by_brute_force(spark):
    """Fingerprints as trees built node by node, and likeness as the share of bytes of common leaves."""
    from base64 import b64encode
    from hashlib import blake2b

    def tree(text):
        raw, leaf, levels = text.encode(), b"", []
        words = [*re.finditer(rb"[^ \t-\r]+", raw)]
        for i, w in enumerate(words):
            end = words[i + 1].start() if i + 1 < len(words) else len(raw)
            start = w.start() if i else 0
            leaf += raw[start:end]
            line = i + 1 == len(words) or b"\n" in raw[w.end() : end]
            data, offs = C.utf8(pa.array([w.group()], pa.large_binary()))
            if line or int(C.word_hashes(data, offs[:1], offs[1:])[0]) % 8 == 0:
                levels.append((leaf, line))
                leaf = b""
        h = lambda x, level: blake2b(x, digest_size=16, person=level).digest()
        if not levels:
            return h(raw, b"blank").hex() + ":", Counter()
        paragraph, section, sections, record = b"", b"", b"", b""
        for n, (x, line) in enumerate(levels):
            own, ends = h(x, b"leaf"), False
            paragraph += own
            if line:
                p = h(paragraph, b"paragraph")
                section, paragraph = section + p, b""
                ends = n + 1 == len(levels) or int.from_bytes(p[:8], "big") % 4 == 0
                if ends:
                    sections, section = sections + h(section, b"section"), b""
            record += own[:6] + (len(x) << 2 | line << 1 | ends).to_bytes(2, "big")
        return h(sections, b"root").hex() + ":" + b64encode(record).decode(), Counter(x for x, _ in levels)

    def like(a, b):
        total = sum(len(x) * n for c in (a, b) for x, n in c.items())
        return 2 * sum(len(x) * n for x, n in (a & b).items()) / total if total else 1.0

    rnd = random.Random(9)
    texts = ["\n".join(" ".join(rnd.choices(BASE.split(), k=rnd.randint(1, 30))) for _ in range(rnd.randint(1, 12))) for _ in range(30)] + ["", " \n", None, texts_of_lines := "line\n" * 900, texts_of_lines]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in fingerprint.compare_edits(rows).collect()}
    for i, x in enumerate(texts):
        (print_, own), (edited, new), (_, nxt) = (tree(t or "") for t in (x, got[i].edited, texts[i - 1]))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (print_, edited)
        assert abs(got[i].near_edited - (1 if print_ == edited else like(own, new))) < 1e-9
        assert abs(got[i].near_next - (1 if print_ == tree(texts[i - 1] or "")[0] else like(own, nxt))) < 1e-9
    assert {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(rows).collect()} == {i: r.fingerprint for i, r in got.items()}


def test_differing_on_repeats():
    """Many repeated lines take no more than their number, and what differs is rebuilt right."""
    import time

    rnd = random.Random(1)
    lines = [rnd.choice(["a b", "c d", "e f"]) for _ in range(6000)]
    other = [*lines[:1000], "x y", *lines[1000:3000], *lines[3005:], "z"]
    p, q = "\n".join(lines), "\n".join(other)
    prints = [fingerprint.compose(*fingerprint.leaves(*C.utf8(pa.array([x], pa.large_string()))))[0] for x in (p, q)]
    began = time.time()
    found = fingerprint.differing(*prints)
    assert time.time() - began < 5
    at, out = 0, ""
    for i, j, k, m in found:
        out += p[at:i] + q[k:m]
        at = j
    assert out + p[at:] == q


def test_edits_after_long_runs():
    rnd = random.Random(2)
    unspaced = "".join(rnd.choices("abcdefghij", k=70_000))
    for run in (unspaced, "é" * 30_000, "word " * 20_000):
        lines = [" ".join(rnd.choices(BASE.split(), k=40)) for _ in range(60)]
        a = "\n".join([lines[0], run, *lines[1:]])
        b = "\n".join([lines[0], run, *lines[1:30], "an inserted line", *lines[30:45], "changed " + lines[45], *lines[46:]])
        prints, sizes = [], []
        for x in ("first of all", a, "", b, run):
            data, offs = C.utf8(pa.array(["before it", x, "after it"], pa.large_string()))
            record, first, root = fingerprint.leaves(data, offs)
            sizes.append([int(((record[i:j] >> 2) & 16383).sum()) for i, j in zip(first[:-1], first[1:], strict=True)])
            assert sizes[-1] == [9, len(x.encode()), 8]
            prints.append(fingerprint.compose(record, first, root)[1])
        p, q = a.encode(), b.encode()
        found = fingerprint.differing(prints[1], prints[3])
        at, out = 0, b""
        for i, j, k, m in found:
            out += p[at:i] + q[k:m]
            at = j
        assert out + p[at:] == q and 2 <= len(found) and sum(j - i for i, j, _, _ in found) < 1000
        assert fingerprint.differing(prints[1], prints[1]) == [] and fingerprint.differing(prints[2], prints[1]) == [(0, 0, 0, len(p))]
    edited = unspaced[:20_000] + "an edit" + unspaced[20_000:]
    whole = []
    for x in (unspaced, edited):
        data, offs = C.utf8(pa.array([x], pa.large_string()))
        whole.append(fingerprint.leaves(data, offs)[:2])
    assert fingerprint.likeness(*whole[0], *whole[1])[0] > 0.7


def test_html():
    page = '<html><head><title>T</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one<br>two\n three<p>four</article><div class="comments">x</div><footer>f</footer>'
    assert html.main_text(page) == "A & B\none two three\nfour"
    assert html.main_text(None) == html.main_text("") == ""


def test_html_ratio_decides():
    body = [f"Body line {i} holds a long run of plain words, so that it has much text for its tags and is the content." for i in range(6)]
    divs = "".join(f"<div>{b}</div>" for b in body)
    links = "".join(f'<div><a href="{i}"><span><b>t{i}</b></span></a></div>' for i in range(8))
    for tag in ("article", "div"):  # one teaser in an article, and none
        page = f'<body><{tag}><h2>Teaser</h2><p><a href="x">Read on</a></p></{tag}>{links}{divs}{links}</body>'
        got = html.main_text(page).split("\n")
        assert [x for x in got if x in body] == body and "Teaser" not in got and "t4" not in got
    # An article around all: its own dense lines go, its short plain ones stay.
    got = html.main_text(f"<article><h1>Title</h1>{divs}<p>No.</p>{divs}{links}</article>").split("\n")
    assert got[:14] == ["Title", *body, "No.", *body] and "t4" not in got


def test_html_asides():
    body = [f"Body line {i} holds a long run of plain words, so that it has much text for its tags and is the content." for i in range(6)]
    ps, menu = "".join(f"<p>{b}</p>" for b in body), "<ul><li><a href=1>Home</a><li><a href=2>About us</a></ul>"
    whole = [
        f'<body><article class="post has-sidebar">{ps}</article>',
        f'<body><nav>{menu}</nav><div class="no-sidebar"><article>{ps}</article></div><div class="sidebar"><p>{body[0]}</p></div>',
        f'<body><main class="search-results">{ps}</main><footer><p>{body[0]}</p></footer>',
        f'<body><article id="comment-policy">{ps}</article>',
        f'<body><form id="aspnetForm"><div>{menu}</div><article>{ps}</article></form>',
        f"<body><nav>{menu}<article>{ps}</article>",
        f'<body><form id="aspnetForm">{ps}</form><footer>Imprint</footer>',
    ]
    for page in whole:
        assert html.main_text(page).split("\n") == body, page
    # Readers' comments, related articles and a dialog stay out, however long.
    long = "".join(f"<p>{b} Others say so too, at some length and more than once.</p>" for b in body * 3)
    for more in (f'<div class="comments">{long}</div>', f'<aside class="related"><article>{long}</article></aside>', f"<dialog>{long}</dialog>", f'<ol class="commentlist"><li><article class="comment">{long}</article></ol>', f"<footer>{long}</footer>"):
        assert html.main_text(f"<body><article>{ps}</article>{more}").split("\n") == body, more


def test_counterfactuals(spark):
    """A term that goes with the label gets false positives on neutral mentions; the penalty takes them away."""
    rnd = random.Random(12)
    plain = [w for w in BASE.split() if len(w) > 2]

    def say(*more):
        words = [*rnd.choices(plain, k=12), *more]
        rnd.shuffle(words)
        return " ".join(words)

    rows = [(i, say("vile", "muslims") if i % 2 and i % 10 else say("vile") if i % 2 else say("christians") if i % 8 == 0 else say()) for i in range(600)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(i, say("muslims")) for i in range(100)], "doc_id long, text string")
    without, with_ = (toxicity.fit(docs, labels, counterfactual=x) for x in (0.0, 1.0))
    assert with_.pairs == without.pairs >= 1200
    assert with_.change < 0.1 * without.change
    mean = [toxicity.score(neutral, m).agg({"score": "avg"}).first()[0] for m in (without, with_)]
    assert mean[1] < 0.7 * mean[0] and toxicity.score(neutral, with_).agg({"predicted": "sum"}).first()[0] == 0
    found = toxicity.score(docs, with_).join(labels, "doc_id")
    assert found.where("predicted = toxic").count() >= 594


def test_held_out_accuracy(spark):
    """Operators 3 and 7 on the rows that their queries don't learn from."""
    from pyspark.sql import functions as F

    from fusewright.llm import queries

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    found = queries.op3_language_id(spark, sf).join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    n, right = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right >= 0.97 * n
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = queries.op7_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500 and sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)
    assert sum(r.predicted for r in rows if r.toxic) >= 0.8 * sum(r.toxic for r in rows)


def test_models(spark):
    rows = [(i, ("the cat and the dog %d" if i % 2 else "der hund und die katze %d") % i, "en" if i % 2 else "de") for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.fit(d)
    assert all(r.lang == r.lang_pred for r in language.identify(d, m).collect())
    odd = spark.createDataFrame([(1, None), (2, "12 34"), (3, "")], "doc_id long, text string")
    assert {r.lang_pred for r in language.identify(odd, m).collect()} == {"und"}
    tox = spark.createDataFrame([(i, f"you vile muslim {i}" if i % 4 == 0 else f"a nice muslim day {i}") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    t = toxicity.fit(tox, labels)
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in toxicity.score(tox, t).collect())
    assert abs(t.weights[t.words["muslim"]]) < 0.5
    assert toxicity.score(odd, t).count() == 3
