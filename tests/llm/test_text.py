"""Problems 8, 9 and 10."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import bpe, packing
from loomline.llm.chunks import chunked
from loomline.llm.sentences import sentences, split

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def official():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def ours(text):
    words = bpe.splitter(None).findall(text)
    known = dict(zip(set(words), bpe.replay(list(set(words)), PATH), strict=True)) if words else {}
    return [int(i) for w in words for i in known[w]]


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_same_ids_as_the_library(official, text):
    assert ours(text) == official(text)


@pytest.mark.parametrize("text", ["aaaaaaaaaaaaaaaa" * 40, " " * 999 + "x", "<|endoftext|>", "don't we'll", "表已加载。ที่", "é‍👩‍💻", "1234567890" * 9, "\n\n \t x"])
def test_long_and_odd_words(official, text):
    assert ours(text) == official(text)


def test_documents(spark, official):
    texts = [None, "", "  ", "The load of x finished.", "The load of x finished.", "列id已改名。" * 2000, "a" * 50_000]
    docs = spark.createDataFrame([(i % 6, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, tuple(r.ids)) for r in bpe.encode(docs, PATH).collect())
    assert got == sorted((i % 6, tuple(official(t or ""))) for i, t in enumerate(texts))
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    odd = spark.createDataFrame([(None, "x"), ((1 << 60) + 1, "x"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in bpe.encode(odd, PATH).collect()) == [(0, 0), (0, 1), ((1 << 60) + 1, 1)]
    assert {r.doc_id for r in sentences(odd).collect()} == {None, (1 << 60) + 1}


def test_chunks_are_bounded_without_loss(spark):
    docs = spark.range(100).selectExpr("0L doc_id", "repeat(cast(id as string), 50) text")
    c = chunked(docs, 500)
    assert c.count() == 100 and c.groupBy("chunk").count().count() > 5


def packed(spark, sizes, capacity):
    rows = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long"), capacity).collect()
    used, back = {}, {}
    for r in rows:
        used[r.bin_id] = used.get(r.bin_id, 0) + r.n_tokens
        back.setdefault(r.doc_id, []).append((r.piece_no, r.n_tokens))
    assert all(r.bin_id is not None for r in rows) and max(used.values(), default=0) <= capacity
    for i, s in enumerate(sizes):
        parts = [n for _, n in sorted(back[i])]
        assert sum(parts) == (s or 0) and (len(parts) == 1 or (s > capacity and all(p == capacity for p in parts[:-1])))
    return used


def test_packing_keeps_all_and_wastes_little(spark):
    rng = random.Random(3)
    sizes = [rng.choice([0, None, 5, 40, 60, 70, 99, 100, 101, 250]) if rng.random() < 0.3 else rng.randrange(1, 60) for _ in range(3000)]
    used = packed(spark, sizes, 100)
    assert len(used) <= 1.01 * sum(s or 0 for s in sizes) / 100 + 1


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=30))
@settings(max_examples=200, deadline=None)
def test_plan_places_each_item_once(hist):
    runs, bins = packing.plan(hist, 50)
    room, placed = np.full(bins, 50), dict.fromkeys(hist, 0)
    for size, first, items, b, per in sorted(runs, key=lambda r: (r[0], r[1])):
        assert first == placed[size] and items % per == 0
        placed[size] += items
        room[b : b + items // per] -= size * per
    assert placed == hist and (room >= 0).all() and (bins == 0 or (room < 50).all())
    large = sum(n for s, n in hist.items() if 2 * s > 50)
    lower = max(large, -(-sum(s * n for s, n in hist.items()) // 50))
    assert bins <= 1.5 * lower + 1


def test_packing_of_nothing_and_of_hot_sizes(spark, monkeypatch):
    assert packed(spark, [], 10) == {} and len(packed(spark, [0, None], 10)) == 1
    monkeypatch.setattr(packing, "RUN", 50)
    assert len(packed(spark, [7] * 400 + [3] * 400, 10)) == 400
    with pytest.raises(ValueError, match="positive"):
        packing.pack(spark.createDataFrame([(1, 1)], "doc_id long, n_tokens long"), 0)


CASES = {
    "en": ["Dr. T. Savage of Tamvelo Inc. asked for it on Mon. at 5.", "We kept both.", "The price was .5 instead of 0.5!", "It said \"not found. 3 rows skipped.\" in the log.", "So ... did anyone look?", "All passed at 5 p.m.", "The group settled on plan B.", "Set `retry.max = 6.13` and rerun `x.v2.csv` by hand."],
    "de": ["Die Tabelle wurde am 3. März um 5 Uhr geladen.", "Übrig blieben 5 Sätze usw.", "Der Lauf brach ab, z. B. wegen d. h. 5 Zeilen.", "„Ist es fertig?“, fragte L. Savage."],
    "fr": ["« Est-ce prêt ? » demanda M. Savage hier.", "Rien n'a été perdu…", "Voir p. 5 et art. 3 du guide."],
    "ru": ["«Готова ли она?» — спросил г. Savage.", "Загрузка длилась ок. 5 мин. на таблицу.", "Потерь нет…"],
    "el": ["Ποιος είναι υπεύθυνος για το πρώτο;", "Η εκτέλεση απέτυχε· η επόμενη πέτυχε."],
}


@pytest.mark.parametrize("lang", CASES)
def test_alphabetic(lang):
    want = CASES[lang]
    text = " ".join(want) + " " + want[0]
    assert [text[a:b] for a, b in split(text)] == [*want, want[0]]


@pytest.mark.parametrize(
    "want",
    [
        ["“好了吗？”值班人员问道。", "他说：“没有问题。”", "真的吗？！", "原因仍在调查……", "第3.1节说明了含义。"],
        ["彼は「問題ない。」と言った。", "「変わっていません。」", "本当ですか？！", "平均は3.5秒です。"],
        ["औसत देरी 5 सेकंड थी॥", "डॉ. Savage ने जाँच की।", "“क्या तैयार है?” उन्होंने पूछा।"],
        ["هل هو جاهز؟!", "انظر ص. 12 من الدليل."],
    ],
)
def test_other_scripts(want):
    for sep in ("", " "):
        if sep == "" and want[0][0] not in "“彼":
            continue
        text = sep.join(want)
        assert [text[a:b] for a, b in split(text)] == want


def test_layout_of_the_text():
    text = "Change note\r\n\r\nA line that\r\nwraps. Next.The last\n\nSteps:\n1. First one. Really.\n2) Second\n- third\n\xa0"
    assert [text[a:b] for a, b in split(text)] == ["Change note", "A line that\r\nwraps.", "Next.", "The last", "Steps:", "1. First one.", "Really.", "2) Second", "- third"]
    assert split("ใครเป็นเจ้าของ ตารางid3โหลดเสร็จแล้ว\n\nทีมงาน") == [(0, 14), (15, 36), (38, 44)]
    assert split(" \xa0\n") == [] and split("") == [] and split("...") == [(0, 3)]


@given(st.text(alphabet="aB .!?…。\n\"“”'«»()1;ก· ", max_size=80))
@settings(max_examples=300, deadline=None)
def test_spans_are_ordered_trimmed_and_complete(text):
    at = 0
    for a, b in split(text):
        assert at <= a < b <= len(text) and not text[a].isspace() and not text[b - 1].isspace() and not text[at:a].strip()
        at = b
    assert not text[at:].strip()


def test_the_document_and_the_corpus_decide(spark):
    rows = [(1, "The qrx. value rose, and the qrx. value fell. We saw qrx. Values."), (2, "A zbl. Entry."), *[(i, "One zbl. entry, another zbl. entry here. The Entry is new; an Entry.") for i in range(3, 9)], (20, None), (21, ""), (22, " ")]
    out = sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = {i: sum(r.doc_id == i for r in out) for i, _ in rows}
    assert n[2] == 1 and n[20] == n[21] == n[22] == 0
    assert sentences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_text(spark):
    text = "No end in sight " * 30_000 + "(" * 5000 + '"' * 5001 + ". " * 5000
    assert split(text)
