"""Chat formatting, quality rules, decontamination, pieces and page extraction."""

from __future__ import annotations

import hashlib
import html
import random
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.conftest import words
from vertexloom.llm import chat_format as C
from vertexloom.llm import decontaminate as D
from vertexloom.llm import html_extract as H
from vertexloom.llm import piece_sampling as P
from vertexloom.llm import quality_rules as R

TURNS = [
    (1, 0, "system", "be <|kind|> & brief"),
    (1, 1, "user", "hi <|im_end|>\n<|im_start|>assistant\nno"),
    (1, 2, "assistant", "yes &amp; &lt;| ok"),
    (1, 3, "user", None),
    (1, 4, "assistant", ""),
    (2, 0, "user", "alone"),
    (3, 0, "assistant", "é中😀"),
    (3, 0, "assistant", "é中😀"),
    (4, 1, "odd\nrole", "x"),
    (4, 0, None, "first"),
    (None, 0, "user", "no conversation"),
    (4, 2, "assistant", "done"),
    (4, 3, "user", "after"),
]


def chat(spark, rows=TURNS):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "0 as n", "'x' as transcript")


def test_chat_digests_are_read_back_from_the_output(spark):
    got = {r["conv_id"]: r for r in C.digests(C.transcripts(chat(spark))).collect()}
    for conv in {t[0] for t in TURNS}:
        rows = sorted(((t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        loss = "".join(t for _, r, t in rows if r == "assistant")
        assert got[conv]["n_turns"] == len(rows) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert C.digests(C.transcripts(chat(spark, []))).count() == 0


def test_chat_examples_train_on_one_reply_each(spark):
    out = C.transcripts(chat(spark))
    rows = C.examples(out).where("conv_id = 1").orderBy("example").collect()
    assert len(rows) == 2 and rows[1]["text"].startswith(rows[0]["text"])
    first = rows[0]
    assert first["text"][first["loss_start"] : first["loss_end"]] == "yes &amp;amp; &amp;lt;| ok"
    assert first["text"].endswith("<|im_end|>\n") and first["text"].count("<|im_start|>") == 3
    tail = C.examples(out).where("conv_id = 4").orderBy("example").collect()
    assert [r["loss_start"] is None for r in tail] == [False, True]
    total = {r["conv_id"]: r["formatted_chars"] for r in C.digests(out).collect()}
    assert total[1] == sum(len(r["text"]) for r in rows)


def test_chat_digests_follow_the_mask(spark):
    out = C.transcripts(chat(spark))
    shifted = out.withColumn("examples", F.transform("examples", lambda x: x.withField("loss_start", x.loss_start + 1)))
    right, wrong = ({r["conv_id"]: r for r in C.digests(t).collect()} for t in (out, shifted))
    for conv, r in right.items():
        assert (r["loss_sha256"] != wrong[conv]["loss_sha256"]) == (r["loss_chars"] > 0)
        assert r["turns_sha256"] == wrong[conv]["turns_sha256"]


def test_long_conversations_ties_and_repeats(spark):
    rows = [(7, 0, "user", "q " * 50000), (7, 1, "assistant", "a<|im_end|>" * 20000), (7, 1, "assistant", "a<|im_end|>" * 20000), (7, 1, "assistant", "b"), (None, 0, "assistant", "x"), (None, 0, "user", "y")]
    got = {r["conv_id"]: r for r in C.digests(C.transcripts(chat(spark, rows))).collect()}
    assert got[7]["n_turns"] == 4 and got[7]["loss_chars"] == 2 * 11 * 20000 + 1 and got[None]["loss_chars"] == 1


def rule_brute(text):
    w = (text or "").encode().split()
    t = text or ""
    solid = b"".join(w).decode()
    lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    covered = {p + k for p, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    return (len(w), len(solid), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_rule_statistics_against_brute_force(spark, docs, corpus):
    extra = [(200, "a b\na b\n\na  b\n# * $ %& |<>"), (201, ("one two three four five six " * 9).strip()), (202, "x y z " * 7000)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).selectExpr("*", "1 as n_words_", "2 as h")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in R.measure(df).collect()}
    assert got == {i: rule_brute(t) for i, t in [*corpus, *extra]}


@pytest.mark.parametrize("n,rate,level", [(50, 0.1, 0.05), (400, 0.02, 0.01), (10, 0.01, 0.01), (0, 0.1, 0.1)])
def test_binomial_bound_is_exact(n, rate, level):
    q = Fraction(rate)
    total, k = Fraction(0), -1
    for i in range(n):
        total += comb(n, i) * q**i * (1 - q) ** (n - i)
        if total > Fraction(level):
            break
        k = i
    assert R.most_rejections(n, rate, level) == k


def test_rules_reject_junk_and_keep_good_texts(spark, empty_docs):
    rng, rows, labels = random.Random(6), [], []
    for i in range(900):
        w = words(rng, rng.randrange(20, 60))
        good = i % 10 != 0
        rows.append((i, " ".join(w) if good else " ".join(x + "###" for x in w)))
        labels.append((i, int(good)))
    rows += [(5000, None), (5001, "short"), (5002, "a b c d e " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in R.quality_rules(docs, lab, alpha=0.2).collect()}
    assert len(got) == 903 and all(got[i]["base_failed"] and not got[i]["kept"] for i in (5000, 5001, 5002))
    assert not any(got[i]["kept"] for i in range(0, 900, 10))
    assert sum(not got[i]["kept"] for i in range(900) if i % 10) <= 0.2 * 810
    # too few labels to certify anything: only the base rules hold
    none = R.quality_rules(docs, lab.limit(5)).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)
    assert R.quality_rules(empty_docs, lab).count() == 0


def test_admitted_levels_against_brute_force(spark):
    rng, rows, labels = random.Random(16), [], []
    for i in range(700):
        w = words(rng, rng.choice([20, 40, 350]))
        for _ in range(rng.choice([0, 0, 0, 1, 2, 9])):
            w[rng.randrange(len(w))] += rng.choice(["#", "|", "77", "ABC", "%%%%"])
        rows.append((i, " ".join(w)))
        labels += [(i, 1 if rng.random() < 0.9 else 0)] * (1 if i % 50 else 2)
    rows += [(3, None), (9, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1)], "doc_id long, quality int")
    got = {r["stratum"]: (r["n_good"], r["most"], r["level"]) for r in R.certify(R.measure(docs), lab.where("doc_id % 3 != 0"), 0.1, 0.2).collect()}
    good: dict = {0: [], 1: []}
    for i, t in rows:
        n, chars, symbols, dup, repeat = rule_brute(t)
        if n < 10 or 100 * repeat > 20 * n or i % 3 == 0:
            continue
        x = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}
        x |= {"n_lines": len([y for y in t.split("\n") if y.strip()]), "n_upper": sum(c.isupper() for c in t), "n_digits": sum(c.isdigit() for c in t)}
        first = next((k for k in range(R.LEVELS + 1) if any(eval(what.replace("greatest", "max"), {"max": max}, x) > loose - (loose - tight) * k / R.LEVELS + 1e-12 for what, loose, tight in R.RULES.values())), R.LEVELS + 1)
        good[int(n >= R.STRATA[0])] += [first] * sum(a == i and q == 1 for a, q in labels)
    want = {}
    for s, firsts in good.items():
        most = R.most_rejections(len(firsts), 0.1, 0.1)
        passed = [k for k in range(R.LEVELS + 1) if sum(f <= k for f in firsts) <= most]
        want[s] = (len(firsts), most, max(passed) if passed and most >= 0 else None)
    assert got == want and all(0 < level < R.LEVELS for _, _, level in want.values())


BENCH = [
    (1, "A farmer sells 12 apples and 30 pears to Maria for 5 dollars each week until the 12 apples are gone entirely."),
    (2, "why does the quiet river turn north before it meets the old stone bridge near town"),
    (3, "too short"),
]


def matched(spark, texts, bench=BENCH):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as pos", "2 as item_id")
    return {(r["doc_id"], r["item_id"]) for r in D.matches(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}


def test_templates_catch_other_numbers_names_and_units(spark):
    rng = random.Random(9)
    noise = " ".join(words(rng, 50))
    again = BENCH[0][1].replace("12", "77").replace("30", "41").replace("Maria", "Tom").replace("dollars", "euros").replace(" 5 ", " 9 ")
    texts = [
        BENCH[0][1],
        f"{noise} {again} {noise}",
        f"{noise} {again.replace('77 apples are', '78 apples are')}",  # one value became two
        f"{noise}. {BENCH[1][1].upper()}! {noise}",
        noise,
        None,
        "",
        "too short",
        "Too short, really",
        f"{again} {noise} {BENCH[0][1]}",
    ]
    assert matched(spark, texts) == {(0, 1), (1, 1), (3, 2), (7, 3), (8, 3), (9, 1)}
    assert matched(spark, [], BENCH) == set() and matched(spark, texts, []) == set()


def test_runs_of_placeholders_match_by_value(spark):
    item = "9 8 7 6 5 4 3 2 1 0 9 8"
    assert matched(spark, ["1 2 3 4 5 6 7 8 9 10 11 12", f"so {item} it goes"], [(1, item)]) == {(1, 1)}


def test_short_items_slots_and_capitals(spark):
    bench = [(1, "why did the quiet river turn"), (2, "Anna pays 3 kg, 4 kg, 5 m and 6 m, 7 s or 8 s to Bob now"), (3, "42 Maria"), (4, "Paris lies north of Rome and south of Calais, by the old road")]
    texts = [
        "well, why did the quiet river turn so late",
        "why did the quiet river",
        "Today Carl pays 13 kg, 14 kg, 15 m and 16 m, 17 s or 18 s to Dan now",
        "Today Carl pays 13 kg, 14 kg, 15 m and 16 m, 17 s or 17 s to Dan now",
        "is it 42 Maria",
        "is it 43 Maria",
        "so Oslo lies north of Bern and south of Genua, by the old road",
        bench[3][1].lower(),
        bench[3][1].upper(),
        "x y " * 40000 + bench[0][1],
        "... , !!! ()",
    ]
    assert matched(spark, texts, bench) == {(0, 1), (2, 2), (4, 3), (6, 4), (7, 4), (8, 4), (9, 1)}


def kinds(text, names=True):
    """(template word, word) of each word that isn't all punctuation."""
    strip, out, raw = ".,;:!?\"'()[]{}", [], text.split()
    number = lambda w: regex.fullmatch(r"[$€£]?[+-]?[0-9][0-9.,:/%]*", w.strip(strip) + "".join(c for c in w[len(w.rstrip(strip)) :] if c in ".,:")) or regex.fullmatch(r"[$€£]?[+-]?[0-9][0-9.,:/%]*", w.strip(strip))
    for i, w in enumerate(raw):
        b = w.strip(strip)
        if not b:
            continue
        t = b.lower()
        if number(w):
            t = "<number>"
        elif names and i and regex.fullmatch(r"\p{Lu}\p{Ll}+", b) and raw[i - 1][-1] not in ".!?:":
            t = "<name>"
        elif i and b.lower() in D.UNITS and number(raw[i - 1]):
            t = "<unit>"
        out.append((t, b.lower()))
    return out


def slots_agree(doc, item, pairs):
    seen = {(doc[i][1], item[j][1]) for i, j in pairs if doc[i][0].startswith("<")}
    return len({a for a, _ in seen}) == len({b for _, b in seen}) == len(seen)


def leak_brute(texts, bench):
    """All alignments of all documents and items, window by window."""
    out = set()
    for d, t in enumerate(texts):
        doc = kinds(t or "")
        for item_id, x in bench:
            item, forms = kinds(x), [kinds(x), kinds(x, False)]
            first = [kinds("x " + x)[1:2], kinds("1 " + x)[1:2], kinds("x " + x, False)[1:2]]
            n = min(8, len(item))
            for shift in range(1 - len(item), len(doc)):
                at = []
                for p in range(len(item) - n + 1):
                    if 0 <= p + shift <= len(doc) - n:
                        here = doc[p + shift : p + shift + n]
                        options = [f[p : p + n] for f in forms] + ([o + f[1:n] for o in first for f in forms] if p == 0 else [])
                        slots = all(a.startswith("<") for a, _ in here)
                        if any([a for a, _ in here] == [a for a, _ in o] and (not slots or [b for _, b in here] == [b for _, b in o]) for o in options):
                            at.append(p)
                if n and len(at) >= min(3, len(item) - n + 1) and slots_agree(doc, item, {(p + k + shift, p + k) for p in at for k in range(n)}):
                    out.add((d, item_id))
    return out


def test_matches_against_all_alignments(spark):
    rng = random.Random(21)
    pool = [*words(rng, 12), "12", "3.5", "$7", "Anna", "Bob", "kg", "km", "(so)", "end."]
    bench = [(i, " ".join(rng.choices(pool, k=k))) for i, k in enumerate([1, 3, 5, 8, 9, 12, 20, 25])]
    texts = [None, "", "?!", *(" ".join(rng.choices(pool, k=rng.randrange(1, 60))) for _ in range(25))]
    for _, item in bench * 3:
        copied = [rng.choice(["8", "99"]) if w in ("12", "3.5") and rng.random() < 0.4 else rng.choice(["Tom", "Eva"]) if w == "Anna" else w for w in item.split()]
        texts.append(" ".join([*rng.choices(pool, k=6), *copied, *rng.choices(pool, k=6)]))
    want = leak_brute(texts, bench)
    assert matched(spark, texts, bench) == want and len(want) > 15


def test_contaminated_documents_go_and_others_stay(spark, docs):
    bench = spark.createDataFrame([(1, docs.where("doc_id = 92").first()["text"])], "item_id long, text string")
    kept = D.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} == {92, 93}


def lattice_brute(unit, pieces):
    """All segmentations of a unit with their probabilities."""
    table = dict(zip(pieces.hashes.tolist(), zip(pieces.ids.tolist(), pieces.weights.tolist(), strict=True), strict=True))

    def h(s):
        x = np.zeros(1, np.uint64)
        for c in P.points(s):
            x = P.mix(x * P._ROLL + np.uint64(c))
        return int(x[0])

    def cut(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if hit := table.get(h(s[:k])):
                for rest, w in cut(s[k:]):
                    yield (hit[0], *rest), hit[1] + w

    found = {ids: np.exp(w) for ids, w in cut("▁" + unit)}
    total = sum(found.values())
    return {k: v / total for k, v in found.items()}


def sliced(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw])


def test_a_unit_has_the_same_shares_in_any_batch():
    pieces, rng = P.Pieces(P.model_path()), random.Random(3)
    unit = "misunderstandings"

    def table(text):
        out = P.Lattices(pieces)
        data, begin, _ = P.unit_spans(*sliced([text]))
        out.find(data, begin, np.diff(np.r_[begin, len(data)]))
        return out

    alone = table(unit)
    for _ in range(3):
        assert nodes(alone) <= nodes(table(" ".join([*words(rng, 400), unit])))


def nodes(table):
    """The edges of each node, as shares summed up and pieces."""
    out = set()
    for i in np.flatnonzero(~table.start):
        stop = int(table.opens[i])
        while table.below[stop] != table.total[i]:
            stop += 1
        out.add((tuple(table.below[table.opens[i] : stop + 1].tolist()), tuple(table.piece[table.opens[i] : stop + 1].tolist())))
    return out


def test_samples_have_the_lattice_probabilities():
    pieces = P.Pieces(P.model_path())
    want = lattice_brute("thing", pieces)
    n = 20000
    ids, count = P.sample_slice(np.arange(n), *sliced(["thing"] * n), P.Lattices(pieces))
    got = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(count)[:-1]))
    assert set(got) <= set(want) and len(want) > 10
    assert max(abs(got[k] / n - p) for k, p in want.items()) < 0.015


def test_round_trip_and_reproducible_samples(spark, docs, empty_docs):
    odd = [(1000, "a ▁ b\n\n  c\t\x00 \U0001f600"), (1001, "▁▁"), (1002, " "), (1003, "x" * 30000), (1004, "\n"), (1005, "  two   spaces \n    four" + " " * 40), (None, "a null key")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "5 as pieces_", "'q' as decoded_")
    a = {r["doc_id"]: r for r in P.round_trip(df).collect()}
    assert len(a) == df.count() and all(r["lossless"] for r in a.values())
    assert a[80]["n_pieces"] == a[81]["n_pieces"] == 0
    b = {r["doc_id"]: r["pieces_sha256"] for r in P.round_trip(df.repartition(5)).collect()}
    assert b == {i: r["pieces_sha256"] for i, r in a.items()}
    assert a[70]["pieces_sha256"] != a[71]["pieces_sha256"]  # equal texts, other keys
    assert P.round_trip(empty_docs).count() == 0
    clash = P.encode_and_decode(df.selectExpr("doc_id", "text", "'x' as Pieces", "7 as decoded", "8 as key"))
    assert clash.columns == ["doc_id", "text", "key", "pieces", "decoded"] == P.decode(P.encode(df.selectExpr("doc_id", "text", "7 as decoded", "8 as key"))).columns
    assert clash.where("decoded != coalesce(text, '') or key != 8").count() == 0


def test_repeated_rows_are_cut_alike(spark):
    rows = [(1, "a repeated row of words")] * 3 + [(1, "other text"), (2, "a repeated row of words")]
    got = P.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 5 and len({r["pieces_sha256"] for r in got if r["doc_id"] == 1}) == 2 and all(r["lossless"] for r in got)


def test_spaces_may_share_a_piece():
    pieces = P.Pieces(P.model_path())
    assert any(P.SPACE * 2 in pieces_ for pieces_ in spelled(pieces, "    x", 400))


def spelled(pieces, text, n):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.model_path())
    ids, _ = P.sample_slice(np.arange(n), *sliced([text] * n), P.Lattices(pieces))
    return {m.id_to_piece(int(i)) for i in ids}


ARTICLE = "<article><h1>Title &amp; more</h1><p>Some  <b>long</b> words\n here about things that matter.<br>And on.</p><p>Second paragraph, with&nbsp;text &lt;tag&gt; inside.</p>{}</article>"
FRAME = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>About us</a></li></ul></nav><!-- c --><div class='ad'>Buy now cheap things today</div>{}<footer>&copy; someone, all rights</footer></body></html>"
TEXT = "Title & more\nSome long words here about things that matter. And on.\nSecond paragraph, with text <tag> inside."


def pages(spark, htmls):
    return spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string").selectExpr("*", "1 as text")


def test_extraction(spark):
    inner = "<aside>See also other pages</aside><div class='comments'><p>First! Nice one, great article, thanks.</p></div><form><p>Your mail</p></form>"
    htmls = [FRAME.format(ARTICLE.format(""))] * 20 + [FRAME.format(ARTICLE.format(inner)), None, "", "plain &amp; simple words", FRAME.format(ARTICLE.format(""))[:-200], FRAME.format(ARTICLE.format("").replace("article>", "div>"))]
    got = {r["page_id"]: r for r in H.extract_pages(pages(spark, htmls)).collect()}
    assert all(got[i]["text"] == TEXT and got[i]["n_chars"] == len(TEXT) for i in [*range(21), 25])
    assert got[21]["text"] == got[22]["text"] == ""
    assert TEXT.startswith(got[24]["text"][:40])
    assert H.extract_pages(pages(spark, htmls).where("page_id < 0")).count() == 0
    twice = H.extract_pages(pages(spark, htmls).selectExpr("1 as page_id", "url", "html").union(pages(spark, htmls).selectExpr("cast(null as long)", "url", "html"))).collect()
    assert sorted(r["text"] for r in twice) == sorted([r["text"] for r in got.values()] * 2)


def test_marks_are_whole_names_and_never_take_the_article():
    article = ARTICLE.format("")
    scores = {f"t:{e}{n}": -0.1 for e in ("", "/") for n in (*H.BLOCKS, *H.DROPPED, *H.INLINE, "other")}
    for wrapper in ("<div class='layout with-sidebar'>{}</div>", "<div id='page' class='site no-header'>{}</div>", "<div class='sidebar'>{}</div>", "<div data-id='ad' data-role='banner'>{}</div>", "<title-bar>{}</title-bar>", "<div class='ad-free' title=it's>{}</div>", "<form class=site>{}</form>"):
        assert H.extract(FRAME.format(wrapper.format(article)), scores) == TEXT
    parts = "<section id='side-effects'><p>Side effects are rare here.</p></section><h2 id='related-work'>Related work</h2><p id='notice-period'>Notice is one month.</p><div class='social-history'><p>He lived alone then.</p></div><p>Press <button>OK</button> to see <math><mi>x</mi></math> grow.</p>"
    assert H.extract(FRAME.format(ARTICLE.format(parts)), scores).endswith("Side effects are rare here.\nRelated work\nNotice is one month.\nHe lived alone then.\nPress OK to see x grow.")
    assert "Buy now" not in H.extract(FRAME.format(article), scores)


def test_region_is_the_best_contiguous_one():
    rng = random.Random(8)
    for _ in range(40):
        parts = [rng.choice(["<p>", "</p>", "<div>", "</div>", "<li>"]) + " ".join(words(rng, rng.randrange(0, 4))) for _ in range(25)]
        page = "".join(parts)
        scores = {"w:p": 1.0, "w:div": 0.3, "w:li": -1.2, "w:none": -0.5, "t:p": -0.5, "t:/p": -0.5, "t:div": -2.0, "t:/div": -2.0, "t:li": -1.0}
        items = [(scores[t.kind] * (H.n_words(t.text) if t.text else 1)) for t in H.tokens(page) if t.kind]
        best = max([0.0] + [sum(items[i:j]) for i in range(len(items)) for j in range(i + 1, len(items) + 1)])
        total = 0.0
        kinds = [(t.kind, t.text) for t in H.tokens(page) if t.kind]
        text = H.extract(page, scores)
        for i in range(len(kinds)):
            for j in range(i, len(kinds) + 1):
                if abs(sum(items[i:j]) - best) < 1e-9:
                    inside = " ".join(t for _, t in kinds[i:j] if t).split()
                    total = total or (inside == text.split())
        assert total or best == 0


def test_scores_of_marks_and_places_are_learned(spark):
    rng = random.Random(30)
    say = lambda n: " ".join(words(rng, n))
    trap = lambda: f"<div class='teaser xq7'><p>{say(40)}</p></div><blockquote>{say(30)}</blockquote>"
    article = lambda tag: (lambda a, b: (f"<{tag}><h1>{a}</h1><div class='related notice'><p>{b}</p></div><p>{say(1)}</p></{tag}>".replace(f"<p>{b}</p></div>", f"<p>{b}</p></div>"), a, b))(say(4), say(60))
    made = [(trap(), article("article"), trap()) for _ in range(30)]
    htmls = [f"<html><body>{x}{a[0]}{y}</body></html>" for x, a, y in made]
    bare = [f"<html><body>{x}{a[0].replace('article>', 'div>')}{y}</body></html>" for x, a, y in made[:5]]
    marks, scores = H.learn(pages(spark, htmls))
    assert marks["xq7"] < H.OUT and marks["teaser"] < H.OUT and scores["w:blockquote"] < 0 < scores["w:p"]
    got = {r["page_id"]: r["text"] for r in H.extract_pages(pages(spark, htmls + bare)).collect()}
    for i, (x, a, y) in enumerate(made + made[:5]):
        assert got[i].startswith(a[1]) and not any(part in got[i] for part in (x[30:60], y[30:60])), got[i]
        # without learned scores the long text around it is taken
        assert len(H.extract((htmls + bare)[i], {})) > len(got[i])


def test_adverts_inside_quotes_and_very_long_pages():
    inner = "<p>Before it.</p><div id='ad'><p>Buy this now.</p></div><p title=it's>After <a href='/x'>the link</a> it goes on for a few more words.</p>"
    assert H.extract(FRAME.format(ARTICLE.format(inner)), {}).endswith("Before it.\nAfter the link it goes on for a few more words.")
    long = "<article><p>" + "word " * 200_000 + "</p>" + "<b>" * 20_000 + "<p>" + "end " * 9000 + "</p></article>"
    assert H.extract(FRAME.format(long), {}).split() == ["word"] * 200_000 + ["end"] * 9000
    assert H.extract("<p>one two</p><hr><hr><hr><hr><hr><hr><hr><p>six ten</p>", {}) == "one two"  # of equal regions the first


def test_references_are_decoded_once():
    assert H.extract("<p>a &amp;lt; b &#233; &copy " + "word " * 5, {}) == html.unescape("a &amp;lt; b &#233; &copy ") + "word word word word word"


def test_comments_are_found_by_their_structure():
    say = lambda k: f"Reader number {k} says that this was worth the time."
    kinds = [
        lambda k: f"<div class='x{k % 2}'><span class='user-name author'>r{k}</span><p>{say(k)}</p></div>",
        lambda k: f"<article><time>May {k}</time><p>{say(k)}</p></article>",
        lambda k: f"<li><p>{say(k)}</p><button>Reply</button></li>",
    ]
    body = "".join(f"<p>{' '.join(words(random.Random(i), 60))}</p>" for i in range(5))
    for kind in kinds:
        thread = f"<section class='talkback'>{''.join(kind(k) for k in range(12))}</section>"
        for page in (f"<main><h1>A title</h1>{body}{thread}</main>", f"<main><h1>A title</h1>{body}</main>{thread}"):
            assert H.extract(FRAME.format(page), {}) == H.extract(FRAME.format(f"<main><h1>A title</h1>{body}</main>"), {})
    # sections with headings, lists without bylines, and what is most of a page stay
    for stays in ("".join(f"<section><h2>Part {k}</h2><time>May {k}</time><p>{say(k)}</p></section>" for k in range(4)), "<ul>" + "".join(f"<li>{say(k)}</li>" for k in range(9)) + "</ul>"):
        text = H.extract(FRAME.format(f"<main><h1>A title</h1>{body}<div>{stays}</div></main>"), {})
        assert all(say(k) in text for k in range(4))
    posts = "".join(kinds[0](k) for k in range(12))
    assert all(say(k) in H.extract(f"<body><div>{posts}</div></body>", {}) for k in range(12))


def test_buttons_and_copyright_lines():
    end = "<button>Subscribe now</button><p>Copyright &copy; 2024 Example Press</p>"
    assert H.extract(FRAME.format(ARTICLE.format(end)), {}) == TEXT
    inner = "<p>&copy; 2024 is how such a line begins.</p><p>Press <button>OK</button> or <button>No</button> here.</p>"
    assert H.extract(FRAME.format(ARTICLE.format(inner)), {}).endswith("\n© 2024 is how such a line begins.\nPress OK or No here.")


def test_names_are_counted_under_their_outermost_element():
    page = "<article><div class='a b'>one two<div class='a'>three</div></div><p class='ad a'>four</p></article><div class='b ad'>five<i class='c'>six</i></div>"
    assert H.count_marks(page) == {("a", True): 3, ("b", True): 3, ("ad", False): 2}


def test_deep_markup_takes_memory_in_proportion():
    import tracemalloc

    def peak(n):
        page = "<article><p>some words here</p>" + "".join(f"<span class=c{i}>w " for i in range(n)) + "</span>" * n + "</article>"
        tracemalloc.start()
        counts, text = H.count_marks(page), H.extract(page, {})
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert counts["c0", True] == n and counts[f"c{n - 1}", True] == 1 and text.count("w") == n + 1
        return top

    assert peak(20_000) < 6 * peak(5000)
    assert peak(50_000) < 100_000_000
