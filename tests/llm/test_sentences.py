import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import sentences

# each text with its sentences divided by |
CASES = [
    "The U.S. mirror is small.| Dr. P. Quillwick compared sum vs. mean on it.",
    "See Eq. 65 and Sec. 1505.2 for it.| They've moved.| It needs vocab, etc.| The end.",
    "We logged loss, etc. during it.| At 9:06 p.m. the batch recovers by .09.| Done.",
    "He said “It wobbles! I saw it.” and closed it.| She wrote: \"The term saturates.\"| Nothing changed.",
    "\"Why is it odd?\" asked the reviewer.| Can it be that 2.19.1 still drops?!| Well... the score overflows.",
    "Notes on it\n\n|One line is\nbroken here.| Next.",
    "The layer (it was small!) drops again.| Stop... or it drops!\n|Release v3.9.6 fixed No. 26 on the list.",
    "Am 20. März erholt sie sich.| „Wieso wächst sie?“, fragte der Prüfer.| Sie fällt, z. B. nach dem Stück, um 0,1 Punkte.",
    "Sie schrieb: „Sie fällt.“| Siehe Abb. 3 bzw. Tab. 2 zur Sache.| Es fehlen ca. 3,8 Prozent usw. in a.py.",
    "Dr Grodzki oraz prof. Ł. Grodzki badali to.| „Czemu rośnie?” – zapytał recenzent.| Ok. 5,40 wierszy, m.in. wektor, odpadło.",
    "Dnia 11.10.2025 r. krzywa rośnie.| Użyj np. pliku a.txt, tzn. wersji 3.1.",
    "M. Chanter parle d'elle, etc. dans a.py.| « La couche baisse. » écrit-elle.| Ne touchez pas à ça !| Pourquoi ?",
    "Проф. Д. Зимин изучал это.| Ошибка упала до 0.8 (см. рис. 9), т. е. всё растёт.| «Почему?» — спросил рецензент.| Ну... растёт.",
    "损失曲线……还是恢复。|为什么会上升？|“怎么又下降了？”有人问。|损失降到0.74（见图184），随后上升。",
    "「なぜ増える？」という質問が出た。|「戻る。」と彼女は書いた。|loss.logに書き込みます。",
    "हमने 9 कदम चलाए।| क्या यह घटती है?| डॉ. शर्मा ने देखी।| “दर घटती है।” ऐसा लिखा है।| a.bin में दर है।",
    "كتبت: «الطبقة تزداد.»| دربنا النموذج.| لماذا تزداد؟| نعم.",
    "รุ่น0.14.3ทำให้ดีขึ้น| เราฝึกคลังคำไป195ครั้ง[ckpt-a]| ไม่ควรแก้",
    "It starts here.|The next follows.| She said (quietly) no.",
    "Sgt. Miller met Gen. Ortiz in Washington, D.C. on Monday.| See Jan. 5 and Feb. 6 again.| Lo vio el Sr. Gómez.",
    "A (b (c (d (e) f. G) h. I) j. K) l.| Next one.| I lost :( Why?| It came.| Done :)",
    "A 5\" disk spins.| It fails.| He said \"No.\" and left.| He (never closed.| It “stayed open.| End",
    "It​ is fro‍zen. |See Ｅｑ. 2 and Sеc. 3 for it.",
]


def expected(case):
    out, at = [], 0
    text = case.replace("|", "")
    for part in case.split("|"):
        lead = len(part) - len(part.lstrip())
        out.append((at + lead, at + len(part.rstrip())))
        at += len(part)
    return text, out


@pytest.mark.parametrize("case", CASES)
def test_boundaries(case):
    text, want = expected(case)
    assert sentences.splitter().spans([text])[0] == want


def test_chunks_compose_to_the_whole():
    rng = random.Random(4)
    texts = ["\n\n".join(expected(c)[0] for c in rng.sample(CASES, 6)) for _ in range(40)] + ["", "\n \n", "x" * 500, "?" * 300]
    cut = sentences.splitter()
    whole = cut.spans(texts)
    for chunk in (1, 7, 33, 64, 200):
        assert cut.spans(texts, chunk) == whole, chunk


@settings(max_examples=150, deadline=None)
@given(st.text("ab .!?\n\"“”()Ab。」「:…-1ก​", max_size=120), st.integers(1, 50))
def test_any_chunking_gives_the_same_and_nothing_is_lost(text, chunk):
    cut = sentences.splitter()
    spans = cut.spans([text])[0]
    assert cut.spans([text], chunk)[0] == spans
    kept = "".join(text[a:b] for a, b in spans)
    strip = lambda s: "".join(c for c in s if not c.isspace() and c != "​")
    assert strip(kept) == strip(text)
    assert all(a < b for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("gap", ["\u200b" * 40, "\u0301" * 3, "\r" * 90])
def test_no_window_bounds_a_rule(gap):
    cut = sentences.splitter()
    text = f"x{'y' * 25} Dr{gap}. Smith came (a (b (c (d (e) f. G) h. I) j. K) l. M). " * 3
    whole = cut.spans([text], len(text))
    for chunk in range(5, 70, 3):
        assert cut.spans([text], chunk) == whole, chunk
    assert cut.spans([text, "x:", "(a. B) c.", text], 31) == [*whole, *cut.spans(["x:"]), *cut.spans(["(a. B) c."]), *whole]


def _outermost(text):
    """Brute force: which brackets of a paragraph are the outermost of a pair."""
    stack, pairs = [], []
    for k, c in enumerate(text):
        if c == "(":
            stack.append(k)
        elif c == ")" and stack:
            pairs.append((stack.pop(), k))
    return {x for a, b in pairs if not any(c < a and b < d for c, d in pairs) for x in (a, b)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("()ab\n", max_size=14), max_size=6))
def test_brackets_pair_like_a_stack(texts):
    texts = [t.replace("\n\n", "\nx") for t in texts if t]
    if not texts:
        return
    sym, _ = sentences.splitter()._symbols(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    out = sentences._pair_up(sym, starts)
    for at, t in zip(starts, texts, strict=True):
        got = {k for k in range(len(t)) if out[at + k] == sentences.OPEN_B}
        assert got == {k for k in _outermost(t) if t[k] == "("}


def test_long_text_and_frame(spark):
    long = "It is a plain line. " * 30_000
    rows = [(1, long, "x"), (2, None, "x"), (3, "", "x"), (4, "  \n", "x"), (5, "One. Two.", "x"), (5, "One. Two.", "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, start_pos string")
    got = sentences.split_sentences(df).collect()
    assert sum(r["id"] == 1 for r in got) == 30_000 and sum(r["id"] == 5 for r in got) == 4
    assert not {r["id"] for r in got} & {2, 3, 4}
    assert all(r["sentence"] == "It is a plain line." for r in got if r["id"] == 1)
    assert sentences.split_sentences(df.limit(0)).count() == 0
