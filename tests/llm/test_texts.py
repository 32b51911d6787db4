"""Problems 2, 3, 5, 8, 9 and 10: forms, sentences, pages, containers, leaks and pieces."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest_llm import clashing, rows, twice
from wordtide.llm import leakage, norm, packing, sentences, splitting, tokens, wrapper

DOCS = "doc_id bigint, text string, book_id string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], DOCS)


# forms


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("ｌｅｖｅｌ", "level"), ("été", "été"), ("c­o​r﻿n", "corn"), ("соrе", "core"), ("\U0001d5bdesk", "desk"), ("a b c d　e", "a b c d e"),
        ("ﬁne ﬂax", "fine flax"), ("half‐yearly", "half-yearly"), ("Ångström", "Ångström"), ("q̣̇", "q̣̇"), ("한", "한"), ("ab", "ab"), ("", ""),
        ("a\nb\r\nc\td", "a\nb\r\nc\td"), ("x‍́y", "x́y"), ("οnly", "only"), ("e​́", "é"),
    ],
)
def test_forms(text, form):
    assert norm.skeleton(text) == form


def test_visible_differences_stay():
    for a, b in (("Corn", "corn"), ("été", "ete"), ("a\nb", "a b"), ("a  b", "a b"), ("“a”", '"a"'), ("x²", "x2"), ("l", "1"), ("O", "0"), ("naïve", "naive")):
        assert norm.skeleton(a) != norm.skeleton(b)


def test_words_of_other_scripts_are_kept_for_reading():
    assert norm.consistent("Старый купец и cоrn, ΛΟΓΟΣ") == "Старый купец и corn, ΛΟΓΟΣ"


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_a_second_pass_changes_nothing(text):
    for f in (norm.skeleton, norm.consistent):
        assert f(f(text)) == f(text)
    assert norm.skeleton(unicodedata.normalize("NFD", text)) == norm.skeleton(unicodedata.normalize("NFC", text))


BOOK = "book_id string, term string, count_ bigint"


def test_half_width_kana_take_their_voicing_mark():
    for f in (norm.skeleton, norm.consistent):
        assert [f(x) for x in ("ｶﾞ", "ﾊﾟ", "ｶﾞｽ", "ｶﾞ", "ｶ゙")] == ["ガ", "パ", "ガス", "ガ", "ガ"]
        assert f("ﾡￂ") == unicodedata.normalize("NFC", unicodedata.normalize("NFKC", "ﾡￂ"))
        assert f("\U0001fbf3") == "3"
    assert norm.skeleton("Ꭱⲟᴠꓐ") == "RovB"


def test_a_second_pass_changes_nothing_in_any_mixture():
    mapped = [*norm.transducer(True).table, *norm.LOOKALIKES, *map(chr, range(0x300, 0x370)), *"ｶﾞﾟｱか゛゜ガabcdeAOK  -"]
    rng = random.Random(7)
    for _ in range(20_000):
        text = "".join(rng.choice(mapped) if rng.random() < 0.7 else rng.choice("abcoeｶﾞﾟ\u3099\u0327\u0301") for _ in range(rng.randrange(1, 7)))
        for f in (norm.skeleton, norm.consistent):
            once = f(text)
            assert f(once) == once


def test_copies_of_one_string_meet_only_other_strings(spark, monkeypatch):
    monkeypatch.setattr("wordtide.llm.common.HOT_ROWS", 3)
    df = spark.createDataFrame([(i, "b", "one text" if i < 300 else "one\u00a0text") for i in range(302)], "doc_id bigint, book_id string, text string")
    bt = spark.createDataFrame([], "book_id string, term string")
    got = rows(norm.lookalike_pairs(bt, df))
    assert len(got) == len(set(got)) == 600 and all((int(a) < 300) != (int(b) < 300) and a < b for _, _, a, b in got)


def test_lookalike_pairs(spark):
    long = "word " * 40_000
    data = [("b", "corn"), ("b", "cоrn"), ("b", "corn​"), ("b", "corn "), ("b", "Corn"), ("c", "corn"), ("b", None), (None, "corn"), ("b", ""), ("b", " "), ("b", "corn")]
    texts = [(1, "Une é", "b"), (2, "Une é", "b"), (3, "Une é", "b"), (4, "Une e", "b"), (5, long, "b"), (6, long.replace("w", "ｗ"), "b"), (7, None, "b"), (8, "", "b"), (9, "Une é", None), (10, "Une é", "c")]
    for change in (lambda x: x, clashing):
        bt, dd = change(spark.createDataFrame([(*x, 1) for x in data], BOOK)), change(spark.createDataFrame(texts, DOCS))
        got = set(rows(norm.lookalike_pairs(bt, dd)))
        like = ["corn", "corn ", "corn​", "cоrn"]
        want = {("term", "b", x, y) for x in like for y in like if x < y} | {("term", "b", "", " ")}
        assert got == want | {("text", "b", "1", "2"), ("text", "b", "2", "3"), ("text", "b", "5", "6")}
    assert norm.lookalike_pairs(bt.limit(0), dd.limit(0)).count() == 0


def test_lookalike_pairs_over_whole_tables(spark, tables):
    groups = {}
    for r in tables("book_terms").select("book_id", "term").distinct().collect():
        groups.setdefault(("term", r.book_id, norm.skeleton(r.term).strip()), []).append((r.term, r.term))
    for r in tables("documents").collect():
        groups.setdefault(("text", r.book_id, norm.skeleton(r.text)), []).append((str(r.doc_id), r.text))
    want = {(k, b, x, y) for (k, b, _), v in groups.items() for x, s in v for y, t in v if x < y and s != t}
    assert set(rows(norm.lookalike_pairs(tables("book_terms"), tables("documents")))) == want
    texts = norm.consistent_texts(docs(spark, ["ｆ", None, ""]), "doc_id", "text")
    assert rows(texts) == [(0, "f"), (1, None), (2, "")]


# sentences


@pytest.mark.parametrize(
    "parts",
    [
        ["The U. P. Canal Co. drained it cf. art. 12, at 5.50 a.m. on the 12th.", "It rose by 7 per cent. in 1848."],
        ["It was shown by Tradell & Co.", "The wool sold at £28. 7s. 3d. a lot, with sail, wax, etc.", "No lock was left."],
        ["“But why,” asked C. Nurlin, “should it be?”", "Every wage fell."],
        ['He said: "One fell. Two rose." and left.', '"Stop!" he cried.'],
        ["Welin noted down: “One. Two. Three.”", "Such was it."],
        ["(The furrow of Ch. 9 is left aside.)", "Why?", "Granted.", "What a seal?!", "69,726.2 quarters were sold."],
        ["No bargain... and yet none came.", "It is lost [see note 4.], but so it was."],
        ["„Das Korn fiel. Der Zoll stieg!“ rief der Amtmann laut.", "Am 27. Juni 1718 zeigte Dr. Volvey: es fiel (vgl. Bd. 1, S. 104), z. B. um 5 Taler, Flachs usw.", "Die Zeit."],
        ["« La laine ! » disait le notaire, car tout va, p. ex. au chap. 3.", "Pourquoi cela selon l'art. 37 ?", "M. Setarn écrivait."],
        ["¡La moneda subía!", "El Sr. Gil escribió en la pág. 108 que no.", "¿Acaso sí?"],
        ["«Цена росла!» — сказал писарь, и купец ушёл.", "В 1729 г. кредит рос, лён и т. д.", "Купец ушёл (см. стр. 5)."],
        ["Ο κ. Δορκάνης έγραψε.", "Γιατί αύξησε το κέρδος;", "«Αύξησε. Έπεσε» έλεγε ο γέροντας."],
        ["书吏说：“商人来了。他走了！”", "难道他走了吗？", "（参看第35卷。）", "价高……但是少。"],
        ["「彼は来た。彼は去った！」と書記は言った。", "価格は7.1割ほど上がった。"],
        ["“वह आया। वह गया!” मुनीम ने कहा।", "डॉ. वर्तक ने लिखा॥", "क्या वह गया?"],
        ["«جاء التاجر. ذهب!» قال القاضي.", "قال د. وردان إن السعر ارتفع.", "هل ذهب؟"],
        ["เสมียนกล่าวว่า“เขามา เขาไป”", "หมู่บ้านรักษาราคา5.5", "เขาไป"],
        ["'The coin fell. The tax rose!' she wrote.", "It was the men's wage."],
        ["It fell?", "the next began in small letters; so it went.", "THE LAST STOOD IN CAPITALS."],
    ],
)
def test_sentences(parts):
    thai = re.search("[฀-๿]", parts[0])
    for glue in (" ", "\n", "\r\n") if not re.search("[　-鿿]", parts[0]) else ("", "\n"):
        text = glue.join(parts)
        assert [text[a:b] for a, b in sentences.spans(text)] == parts
    text = "3. Kapitel\n\n" + ("\n\n" if thai else "  \r\n \r\n").join(parts) + "\n"
    assert [text[a:b] for a, b in sentences.spans(text)] == ["3. Kapitel", *parts]


def test_a_block_of_many_abbreviations_is_not_cut():
    index = "Corn, laws of, " + "; ".join(f"vol. {'ii' * (i % 2) or 'i'}. p. {i}" for i in range(1, 200))
    assert sentences.spans(index) == [(0, len(index))]
    both = f"He read on. {index}. Then he slept."
    assert [both[a:b] for a, b in sentences.spans(both)] == ["He read on.", f"{index}.", "Then he slept."]


def test_sentences_in_other_characters():
    text = "T﻿he ｆａｉｒ． Ｔｈｅ w​age fell at No. 5. It fell"
    assert [text[a:b] for a, b in sentences.spans(text)] == ["T﻿he ｆａｉｒ．", "Ｔｈｅ w​age fell at No. 5.", "It fell"]


@given(st.text(alphabet="ab A.!?\"“”()\n。é ​'", max_size=60))
@settings(max_examples=400, deadline=None)
def test_sentences_hold_all_that_is_not_blank(text):
    found = sentences.spans(text)
    seen, last = set(), 0
    for a, b in found:
        assert last <= a < b <= len(text)
        seen |= set(range(a, b))
        last = b
    for i, c in enumerate(text):
        assert i in seen or c.isspace() or c == "​"


def test_sentences_in_spark(spark):
    long = "The tax fell. " * 30_000
    texts = [None, "", "  \n ", "One. Two.", "No stop", long, "“never closed. " * 400]
    for change in (lambda x: x, clashing):
        got = rows(sentences.sentences(change(docs(spark, texts))))
        assert [r[4] for r in got if r[0] == 3] == ["One.", "Two."] and [r[4] for r in got if r[0] == 4] == ["No stop"]
        assert sum(r[0] == 5 for r in got) == 30_000 and not [r for r in got if r[0] < 3]
    assert sentences.sentences(docs(spark, texts).limit(0)).count() == 0
    assert len(rows(sentences.sentences(twice(docs(spark, ["One. Two."])), with_text=False))) == 4


# pages


def page(rng, site, main, kind=0):
    nav = "".join(f"<li><a href=/{rng.random()}>{x}</a></li>\n" for x in ("Home", "Search", "Help"))
    side = f"<div class=x>\n<p>Most read: The {rng.choice(['Mill', 'Toll', 'Wax'])} and the {rng.choice(['Rye', 'Hop', 'Tin'])}</p>\n<p>Join {rng.randrange(99)} readers of {site}</p>\n</div>\n"
    body = "<div class=footer>\n" + "".join(f"{x}\n" for x in main) + "</div>\n" if main else "<div>\n<p>Nothing is here; try again.</p>\n</div>\n"
    end = f"<footer>\n<p>© {rng.randrange(2000, 2024)} {site}. All rights kept.</p>\n<p>Served in {rng.randrange(99)} ms</p>\n</footer>\n"
    said = f"<div>\n<p>user{rng.randrange(999)} wrote: {rng.choice(['thanks', 'nice part on wax', 'when is the next'])}</p>\n</div>\n" if kind % 3 == 0 else ""
    return f"<html><head><title>T {rng.random()}</title></head>\n<body>\n<ul>\n{nav}</ul>\n{side if kind % 2 else ''}{body}{said}{'' if kind % 2 else side}{end}</body></html>"


def pages(n=120, seed=0):
    rng, out = random.Random(seed), []
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(400)]
    for i in range(n):
        site = f"site{i % 3}"
        text = [" ".join(rng.choices(words, k=rng.randrange(15, 60))) + "." for _ in range(rng.randrange(2, 8))]
        main = [] if i % 17 == 16 else [f"<h2>Chapter {i % 9}</h2>", *(f"<p>{t}</p>" for t in text), "<p>Join 5 readers of " + site + "</p>", f"<p>{text[0][::-1]} one two three</p>"]
        out.append((i, f"https://{site}.invalid/{i}", page(rng, site, main, i), main))
    return out


def test_main_lines(spark):
    data = pages()
    df = spark.createDataFrame([(i, u, h) for i, u, h, _ in data], "page_id bigint, url string, html string")
    want = set()
    for i, _, h, main in data:
        keep = {x for x in main if not x.startswith("<p>Join")}
        want |= {(i, n) for n, line in enumerate(h.split("\n")) if line in keep}
    for change in (lambda x: x, clashing):
        got = {tuple(r) for r in wrapper.main_lines(change(df)).collect()}
        assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97


def test_copies_keep_their_body(spark):
    data = pages()
    again = [(1000 + i, u, h, m) for i, u, h, m in data[:30] for _ in range(2)]
    fetched = [(2000 + i, u, h.replace("Served in ", "Served in 1"), m) for i, u, h, m in data[:30]]
    elsewhere = [(3000 + i, u + "/copy", h, m) for i, u, h, m in data[:30]]
    df = spark.createDataFrame([(i, u, h) for i, u, h, _ in data + again + fetched + elsewhere], "page_id bigint, url string, html string")
    lines = {}
    for i, n in wrapper.main_lines(df).collect():
        lines.setdefault(i, set()).add(n)
    for i in range(30):
        assert lines.get(i) == lines.get(1000 + i) == lines.get(2000 + i) == lines.get(3000 + i)
        assert bool(lines.get(i)) == bool(data[i][3])


def test_a_text_twice_within_a_page_is_no_template(spark):
    data = []
    for i in range(20):
        body = [f"verse {chr(97 + i)} " * 6, f"refrain of song {chr(97 + i)} once more", f"stanza {chr(97 + i)} " * 6, f"refrain of song {chr(97 + i)} once more"]
        data.append((i, f"http://h/{i}", "<ul><li><a>Home</a></li></ul>\n<div>\n" + "".join(f"<p>{x}</p>\n" for x in body) + "</div>"))
    got = wrapper.main_lines(spark.createDataFrame(data, "page_id bigint, url string, html string"))
    assert {tuple(r) for r in got.collect()} == {(i, n) for i in range(20) for n in (2, 3, 4, 5)}


def learnable(data):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(data))), *(pa.array(x) for x in zip(*data))], ["page_id", "host", "url", "html"])
    streams = list(wrapper._streams([batch]))[0]
    return pa.RecordBatch.from_arrays([streams.column(1), pa.array([0] * len(data), pa.int32()), pa.array([1] * len(data)), streams.column(4)], ["host", "part", "first", "stream"])


def test_rows_in_any_order_and_partitioning_give_the_same_lines(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "LEARNED", 20)
    monkeypatch.setattr(wrapper, "MERGED", 2)
    df = spark.createDataFrame([(i, u, h) for i, u, h, _ in pages(300, 3)], "page_id bigint, url string, html string")
    got = [sorted(map(tuple, wrapper.main_lines(x).collect())) for x in (df.coalesce(1), df.repartition(7), df.orderBy(F.rand(5)).repartition(3))]
    assert got[0] == got[1] == got[2] and got[0]


def test_parts_that_repeat_are_found():
    w = wrapper.Wrapper()
    reply = "<section><p>reader {} wrote: so it is with page {} of the book</p></section>"
    for i in range(40):
        w.learn(wrapper.read("<div><p>Home</p><p>Search</p></div>" + "".join(reply.format(chr(97 + k), f"{i:b}".replace("1", "x").replace("0", "y")) for k in range(1 + i % 5))))
    assert any(n[3] and n[0] == "section" for n in w.nodes) and len(w.nodes) <= 4


def test_a_message_of_many_hosts_is_no_body(spark):
    data = [(i, f"http://h{i % 4}/{i}", f"<div><p>Home</p><p>Search</p></div><div><p>{' '.join(f'{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}' for k in range(30))}</p></div>") for i in range(80)]
    data += [(100 + i, f"http://h{i}/x", f"<div><p>Home</p><p>Search</p></div><div><p>Please sign in first.</p></div><!-- {i} -->") for i in range(4)]
    got = {r.page_id for r in wrapper.main_lines(spark.createDataFrame(data, "page_id bigint, url string, html string")).collect()}
    assert got == set(range(80))


def test_pages_of_a_value_are_counted_in_full(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "KEPT", 5)
    monkeypatch.setattr(wrapper, "COUNTS", 50)
    data = [("h", f"http://h/{i}", f"<div><p>new {chr(97 + i % 26)}{chr(97 + i // 26)}</p><p>kept</p>{'<p>now and then</p>' if i % 40 == 0 else ''}</div>") for i in range(400)]
    n = Counter()
    for part in wrapper._learn([learnable(data)]):
        for value, pages_ in zip(part.column("value").to_pylist(), part.column("pages").to_pylist()):
            n[value] += pages_ if value else 0
    assert n["kept"] == 400 and n["now and then"] == 10 and n["new aa"] == 1


def test_parts_beyond_the_nodes_still_count(monkeypatch):
    monkeypatch.setattr(wrapper, "NODES", 8)
    data = []
    for i in range(200):
        tags = ["nav", "aside", "section", "article", "form", "header", "footer", "main", "center", "dl"]
        parts = [f"<{x}><p>notice of {x}</p><p>see the {x}</p></{x}>" for k, x in enumerate(tags) if (i + k) % 7 == 0]
        data.append(("h", f"http://h/{i}", "".join(parts) + f"<div><p>body {chr(97 + i % 26)}{chr(97 + i // 26)}</p></div>"))
    n, nodes = Counter(), 0
    for part in wrapper._learn([learnable(data)]):
        for blob, value, count in zip(*(part.column(x).to_pylist() for x in ("wrapper", "value", "pages"))):
            nodes += len(wrapper.Wrapper.unpack(blob).nodes) if blob else 0
            n[value] += count
    assert nodes <= 8 and all(n[f"notice of {x}"] == sum((i + k) % 7 == 0 for i in range(200)) for k, x in enumerate(tags))


def test_pages_that_are_no_pages(spark):
    data = [(1, "u", None), (None, "u", "<p>x"), (2, None, ""), (3, "http://h/", "a < b <<p>"), (4, "http://h/", "<div><p>one<div>two</p></span></main></div>"), (5, "x", "<!-- open"), (6, "x", "no tags at all " * 50_000), (7, "x", "<script>never closed")]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string")
    got = wrapper.main_lines(df.unionByName(df))
    assert all(r.line_no == 0 for r in got.collect())
    assert wrapper.main_lines(df.limit(0)).count() == 0


def test_wrappers_merge_to_what_one_would_learn():
    data, parts, whole = pages(90, 1), [wrapper.Wrapper() for _ in range(3)], wrapper.Wrapper()
    for i, (_, _, h, _) in enumerate(data):
        if data[i][1].startswith("https://site0"):
            parts[i % 9 // 3].learn(wrapper.read(h))
            whole.learn(wrapper.read(h))
    for p in parts[1:]:
        parts[0].merge(wrapper.Wrapper.unpack(p.pack()))
    assert parts[0].pages == whole.pages == 30
    a, b = ({k for k, v in w.constants().items() if v > 5} for w in (parts[0], whole))
    assert a == b and "home" in a


def test_slots_stay_small_and_keep_what_recurs(monkeypatch):
    monkeypatch.setattr(wrapper, "KEPT", 50)
    slot = wrapper.Slot()
    for i in range(3000):
        slot.add([wrapper.Unit(f"new text {i:b} {'x' * (i % 97)}", [0], 0, False, 0)])
        if i % 10 == 0:
            slot.add([wrapper.Unit("served daily", [0], 0, False, 0)])
    assert len(slot.values) <= 100 and "served daily" in slot.values and slot.n == 3300


# containers


@given(st.lists(st.integers(1, 32), min_size=1, max_size=300))
@settings(max_examples=100, deadline=None)
def test_plan_places_every_item(lengths):
    histogram = np.bincount(lengths, minlength=33)
    plan, left = packing.plan(histogram, 32), histogram.copy()
    for combo, repeats in plan:
        assert repeats > 0 and sum(c * k for c, k in combo.items()) <= 32
        for c, k in combo.items():
            left[c] -= k * repeats
    assert not left.any()
    full = sum(lengths) / 32
    assert sum(r for _, r in plan) <= 1.5 * full + 3


def test_least_squares_is_not_beaten():
    rng = np.random.default_rng(0)
    histogram = np.bincount(rng.integers(2, 14, 4000), minlength=33).astype(float)
    combos = packing.combinations(np.flatnonzero(histogram), 32)
    assert {int((c[0::2] * c[1::2]).sum()) for c in combos} <= {31, 32}
    x = packing.solve(combos, histogram)
    a = np.zeros((33, len(combos)))
    for j, c in enumerate(combos):
        for k in range(3):
            a[c[2 * k], j] += c[2 * k + 1]
    assert (x >= 0).all()
    gradient = a.T @ (a @ x - histogram) / np.sqrt((combos[:, 1::2] ** 2).sum(axis=1))
    assert gradient.min() > -1e-6 * histogram.sum() and np.abs(gradient[x > 0]).max() < 1e-6 * histogram.sum()


def test_containers(spark, tables):
    for change in (lambda x: x, clashing, twice):
        df = change(tables("documents"))
        got = packing.containers(df).collect()
        size = Counter()
        for r in got:
            size[r.container_id] += r.tokens
        want = [len(tokens.tokens_of(r.text)) for r in df.select("text").collect()]
        assert sum(size.values()) == sum(want) and max(size.values()) <= 2048
        assert sorted(r.tokens for r in got) == sorted(min(2048, n - at) for n in want for at in range(0, n, 2048))
        assert sum(size.values()) / (2048 * len(size)) > 0.9


def test_containers_of_odd_texts(spark):
    texts = [None, "", " ", "a", "word " * 5000, "x" * 20_000]
    got = packing.containers(docs(spark, texts)).collect()
    assert {r.doc_id for r in got} == {2, 3, 4, 5}
    assert packing.containers(docs(spark, texts).limit(0)).count() == 0
    same = packing.containers(docs(spark, ["one two three"] * 2000), capacity=30, width=1)
    n = Counter(r.container_id for r in same.collect())
    assert set(n.values()) == {10} and len(n) == 200


# leaks


def words(rng, n, vocabulary=("rent wage corn mill toll wax hop tin rye oat lead salt iron flax hemp sail").split()):
    return [rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(n)]


def leaking(documents, items):
    grams = {}
    for i, t in items:
        w = leakage.words_of(t)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    return sorted({(d, i) for d, t in documents for w in [leakage.words_of(t)] for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())})


def test_leaks(spark, monkeypatch):
    rng = random.Random(0)
    items = [(i, " ".join(words(rng, rng.randrange(14, 40)))) for i in range(30)] + [(90, "too short"), (91, None), (None, "x " * 20), (92, "")]
    own = {i: t.split() for i, t in items[:30]}
    texts = [" ".join(words(rng, 80)) for _ in range(40)]
    for i in range(30):
        cut = own[i][:13] if i % 3 else own[i]
        texts.append(" ".join(words(rng, 20) + cut + words(rng, 20)).upper().replace(" ", ",\n", 3))
        texts.append(" ".join(words(rng, 20) + own[i][:12] + words(rng, 20)))
    texts += [" ".join(words(rng, 60_000) + own[3] + words(rng, 30_000)), None, "", "ｒ" * 50, " ".join(own[4]).replace("e", "е").replace("n", "n​")]
    documents = docs(spark, texts)
    want = leaking([(i, t) for i, t in enumerate(texts) if t], [(i, t) for i, t in items if i is not None and t])
    schema = "item_id bigint, text string, lang string"
    tests = spark.createDataFrame([(i, t, "en") for i, t in items], schema)
    for change in (lambda x: x, clashing, twice):
        assert rows(leakage.leaked(leakage.leaks(change(documents), change(tests)))) == sorted(want, key=repr)
    assert len(want) >= 32
    monkeypatch.setattr(leakage, "INDEXED", 200)
    assert rows(leakage.leaked(leakage.leaks(documents, tests))) == sorted(want, key=repr)
    assert leakage.leaks(documents, tests.limit(0)).count() == leakage.leaks(documents.limit(0), tests).count() == 0


def test_letter_case_of_other_scripts_does_not_matter(spark):
    russian = "Старый купец говорил тот раз что хлеб и вино всегда можно выменять на мех или воск у Нила"
    greek = "Ο παλιός έμπορος έλεγε τότε ότι το ψωμί και το κρασί μπορεί κανείς να τα πάρει με μέλι και νήμα"
    for text in (russian, greek, russian.replace("хлеб", "xлеб")):
        assert leakage.words_of(text.upper()) == leakage.words_of(text) == leakage.words_of(text.lower())
    assert leakage.words_of("Вook Кing") == leakage.words_of("book king")
    items = spark.createDataFrame([(1, russian), (2, greek)], "item_id bigint, text string")
    documents = docs(spark, [russian.upper(), "before it " + greek.upper(), "nothing"])
    assert rows(leakage.leaked(leakage.leaks(documents, items))) == [(0, 1), (1, 2)]


def test_index_misses_nothing_within_the_radius():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**63, 500, dtype=np.uint64)
    near = prints[rng.integers(0, 500, 2000)]
    for k in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64)) * np.uint64(1)
    got = {tuple(x) for x in leakage.Index(prints).near(near).tolist()}
    want = {(i, j) for i, x in enumerate(near) for j in np.flatnonzero(np.bitwise_count(prints ^ x) <= 3)}
    assert got == want and len(want) >= 2000


@given(st.lists(st.integers(0, 3), min_size=13, max_size=13), st.lists(st.integers(0, 3), min_size=13, max_size=13))
@settings(max_examples=100, deadline=None)
def test_weighted_similarity(a, b):
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(9)) for w in (a, b))
    got = leakage.similarities(*(leakage.shingles(np.array(w))[None, :] for w in (a, b)))[0]
    assert got == pytest.approx((x & y).total() / (x | y).total())


def test_near_copies_are_reported(spark):
    text = " ".join(f"w{i}" for i in range(13))
    r = leakage.leaks(docs(spark, [text.replace("w0", "other")]), spark.createDataFrame([(1, text)], "item_id bigint, text string")).collect()
    assert not r or (r[0].equal == 0 and r[0].similarity >= 0.8)


# pieces


@pytest.mark.parametrize("text", ["x" * 30_000, "漢字" * 6000, "a b " * 5000, "\n\n".join(["word " * 900] * 4), " " * 9000, "é" * 6000, "12a-34b-" * 3000, "🙂" * 3000, "\n" * 5000 + "x " * 4000])
def test_pieces_tile_any_text(text):
    found = splitting.pieces(text)
    ids = tokens.tokens_of(text)
    assert bool(found) == (len(ids) > 2048)
    if found:
        assert found[0][0] == 0 and found[-1][1] == len(text)
        for (_, end, _, _), (start, after, _, _) in zip(found, found[1:]):
            assert start <= end < after
        assert all(n <= 2048 and n == len(tokens.tokens_of(text[a:b])) for a, b, n, _ in found)


def test_pieces_over_whole_tables(spark, tables):
    texts = {r.doc_id: r.text for r in tables("documents").collect()}
    over = {d for d, t in texts.items() if len(tokens.tokens_of(t)) > 2048}
    got = {}
    for r in splitting.split_documents(clashing(tables("documents"))).orderBy("doc_id", "piece_no").collect():
        assert r.piece == texts[r.doc_id][r.start_pos : r.end_pos] and r.tokens <= 2048
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == over
    for found in got.values():
        for a, b in zip(found, found[1:]):
            assert b.start_pos < a.end_pos
            assert 60 <= len(tokens.tokens_of(a.piece[b.start_pos - a.start_pos :])) <= 70
    assert splitting.split_documents(docs(spark, [None, "", "short"])).count() == 0


def test_pieces_end_where_sections_end():
    section = "## Part {}\n\n" + "The tax fell again in the town. " * 150
    text = "\n\n".join(section.format(i) for i in range(4))
    found = splitting.pieces(text)
    assert len(found) == 4 and [k for *_, k in found][:3] == ["section"] * 3
    assert all(text[: a[1]].rstrip().endswith("town.") for a in found)
