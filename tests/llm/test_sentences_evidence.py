"""What the document says comes before the corpus, and that before the lists."""

import time

from loomline.llm import sentences as S


def parts(text, corpus=lambda _: (0, 0)):
    return [text[a:b] for a, b in S.split(text, corpus)]


def test_document_overrules_the_list():
    text = "He said no and no again. There is no reason, no cause and no need. The answer was no. Zelda left the room."
    assert parts(text)[-2:] == ["The answer was no.", "Zelda left the room."]
    assert parts("See no. Zelda for this.") == ["See no. Zelda for this."]  # nothing is known of it: the list
    assert parts("no no no no. See no. 5 for this.")[-1] == "See no. 5 for this."  # before a number


def test_corpus_overrules_the_list():
    text = "We like the art. Zelda paints."
    assert parts(text, lambda k: (0, 500) if k == "aart" else (0, 0)) == ["We like the art.", "Zelda paints."]
    assert parts(text) == [text]


def test_no_limits_on_tokens_and_clauses():
    long = "「行きます。」" + "と彼女は静かに" * 30 + "言った。"
    assert parts(long) == [long]
    said = "「다 했다.」 " + "그는 모두가 모인 자리에서 " * 20 + "말했다."
    assert parts(said) == [said]
    began = time.time()
    assert len(parts("a.b" * 200_000 + ". Next one here.")) >= 1 and time.time() - began < 20


def test_first_pass_and_lookup_agree_with_the_plain_way(spark):
    texts = ["See exmp. Zelda for it. The exmp, is old.", "An exmp. is here, an exmp. is there, exmp. all over.", "One line", "", None, "We met Zelda. Then Zelda left.", "He saw exmp. Zelda."]
    rows = list(enumerate(texts)) + [(2, "One line"), (None, "No id here. None.")]
    got = sorted(map(tuple, S.sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    yes, no = S.Counter(), S.Counter()
    for _, t in rows:
        for (kind, w), n in S.evidence(t or "").items():
            (no if kind in "wn" else yes)[S._KEY[kind] + w] += n
    want = sorted(((d, a, b) for d, t in rows if t for a, b in S.split(t, lambda k: (yes[k], no[k]))), key=str)
    assert got == want
