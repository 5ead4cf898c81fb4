"""Names in scripts without case, where no capital letter shows them.

Titles, labels and the words that follow propose them, as fixed values by script. Names
learnt there stand in the gazetteer, by which further mentions are found: by word in scripts
with blanks, by place in a stretch of letters in scripts without.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import regex

#: Letters and marks of scripts without case that part words with blanks, and of those that do not.
_SPACED_SCRIPTS = "Devanagari Bengali Gurmukhi Gujarati Tamil Telugu Kannada Malayalam Sinhala Arabic Hebrew Hangul Ethiopic".split()
_RUN_SCRIPTS = "Han Hiragana Katakana Thai Lao Khmer Myanmar".split()
_SPACED = "[[" + "".join(rf"\p{{{s}}}" for s in _SPACED_SCRIPTS) + r"]&&[\p{L}\p{M}]]"
_RUN = "[[" + "".join(rf"\p{{{s}}}" for s in _RUN_SCRIPTS) + r"ー]&&[\p{L}\p{M}]]"
_EAST, _THAI = r"[\p{Han}\p{Hiragana}\p{Katakana}ー]", r"[\p{Thai}&&[\p{L}\p{M}]]"
#: The same letters for Spark's regular expressions.
RUN_JAVA = "[" + "".join(rf"\p{{Is{s}}}" for s in _RUN_SCRIPTS) + "]"
#: Holds all letters of these scripts and few others; it only spares texts without any.
ANY = re.compile("[\u0590-\u1cff\u2e80-\ud7ff\uf900-\ufdff\ufe70-\ufefe\uff66-\uffdf\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
#: The same blocks for Spark's regular expressions, a letter or mark of them.
ANY_JAVA = "[\u0590-\u1cff\u2e80-\ud7ff\uf900-\ufdff\ufe70-\ufefe\uff66-\uffdf]"
SPACED_WORD = regex.compile(rf"(?V1)(?<![\p{{L}}\p{{M}}]){_SPACED}+(?![\p{{L}}\p{{M}}])")
RUNS = regex.compile(rf"(?V1)(?:{_EAST}+|{_THAI}+|[\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}]+)")
#: Shortest and longest names looked for inside a stretch without blanks.
SHORT, LONG = 2, 16

# Words around names, by script.
_TITLES = (
    r"डॉ\.?|डॉक्टर|श्री|श्रीमती|सुश्री|कुमारी|प्रो\.?|प्रोफ़ेसर|الدكتور|الدكتورة|دكتور|دكتورة|د\.|السيد|السيدة|الأستاذ|الأستاذة|الآنسة|المهندس|المهندسة|البروفيسور"
    r"|ד[\"״]ר|פרופ['׳]|פרופסור|מר|גב['׳]|גברת"
)
_LABELS = (
    r"लेखक|लेखिका|संपर्क|समीक्षक|المؤلف|المؤلفة|الكاتب|الكاتبة|جهة الاتصال|للتواصل|المراجع|מאת|מחבר|מחברת|איש קשר|작성자|저자|담당자|연락처|검토자"
)
_GREETINGS = r"प्रिय|नमस्ते|عزيزي|عزيزتي|مرحبا|שלום"
_WORLD = r"दुनिया|العالم|עולם|सब|الجميع"
_FOLLOW = (
    r"ने|को|से|का|की|के|जी|में|पर|और|तथा|كتب|كتبت|قال|قالت|راجع|راجعت|في|من|إلى|على|عن|أن|هو|هي|כתב|כתבה|אמר|אמרה|בדק|בדקה|את|של|על"
)
#: Only these show that the words before them belong to the name.
_CLOSE = r"ने|जी|كتب|كتبت|قال|قالت|راجع|راجعت|هو|هي|כתב|כתבה|אמר|אמרה|בדק|בדקה"
_THAI_TITLES = (
    r"(?<!\p{Thai})(?:นางสาว|นาย(?!ก(?:รัฐ|เทศ|สมาคม|องค์|สภา|ฯ)|จ้าง|ทุน|แพทย์|หน้า|ทหาร|ตำรวจ|อำเภอ)|นาง(?!สาว|แบบ|ฟ้า|เอก|พยาบาล|รำ)|ดร\.|ศ\.|คุณ(?!ภาพ|สมบัติ|ลักษณะ|ค่า|ธรรม|ูปการ|สามารถ|ต้อง|จะ|ไม่|ควร|ได้|มี|อาจ)|อาจารย์) ?"
)
_THAI_LABELS = r"(?:ผู้เขียน|ผู้แต่ง|ผู้ติดต่อ|ผู้ตรวจสอบ|ติดต่อ) ?[:：] ?"
_THAI_FOLLOW = r"เขียน|กล่าว|ตรวจ|บอก|ได้|เป็น|และ|ส่ง|อยู่|คือ|จะ|ไม่|มี|ที่|ให้|ทำ|พบ|แก้"
_EAST_LABELS = r"(?:作者|联系人|负责人|审阅人|审核人|著者|執筆者|担当者|連絡先|連絡人|聯絡人) ?[:：] ?"
_EAST_FOLLOW = r"已检查|已审阅|审阅了|检查了|写了|写道|说|表示|さん|氏|様|先生|が|は"
#: What can stand right before a name: the border of a stretch of letters, or a word that leads to it.
_EAST_START = r"(?:(?<![\p{L}\p{M}])|(?<=[请由向和与给跟致找問问]|联系|感谢|通知|告诉|[はがをにとの]))"
_NOT_NAME = r"请|联系|感谢|通知|告诉|询问|大学|中学|小学|学院|研究|工程|模型|系统|客座|名誉|荣誉|讲座|特聘|各位|这位|那位|一位|[们的是在了有这那个某每副老女男我你您他她它]"

_WORD = rf"(?!(?:{_FOLLOW})(?!{_SPACED})){_SPACED}{{2,}}"
_CLOSED = rf"(?= (?:{_CLOSE})(?![\p{{L}}\p{{M}}]))"
_BORDER = r"(?=\s*(?:$|\n|[^\s\p{L}\p{M}\p{N}]))"
_TITLED = rf"{_WORD}(?:-{_WORD})*(?:(?: {_WORD}){{1,2}}{_CLOSED})?(?![\p{{L}}\p{{M}}])"
_LABELLED = rf"{_WORD}(?:-{_WORD})*(?:(?: {_WORD}){{1,2}}(?:{_CLOSED}|{_BORDER}))?(?![\p{{L}}\p{{M}}])"
_EAST_NAME = rf"(?:(?!{_NOT_NAME})\p{{Han}})"

#: Group t, l or f: a name after a title, after a label or a greeting, or before a title. Each
#: pattern is tried only on texts with one of the words it needs.
_PLACES = [
    (
        re.compile(f"{_TITLES}|{_LABELS}|{_GREETINGS}| 씨"),
        regex.compile(
            rf"(?V1)(?<![\p{{L}}\p{{M}}])(?:{_TITLES}) ?(?<=[. ])(?P<t>{_TITLED})"
            rf"|(?<![\p{{L}}\p{{M}}])(?:{_LABELS}) ?[:：] ?(?:(?:{_TITLES}) ?(?<=[. ]))?(?P<l>{_LABELLED})"
            rf"|(?<![\p{{L}}\p{{M}}])(?:{_GREETINGS}) (?!{_WORLD})(?P<l>{_TITLED})(?=\s*[,،!।\n])"
            rf"|(?<!\p{{Hangul}})(?P<f>\p{{Hangul}}{{2,4}})(?= 씨(?![\p{{Hangul}}--[가는를의와께도]]))"
        ),
    ),
    (
        re.compile("นาย|นาง|ดร\\.|ศ\\.|คุณ|อาจารย์|ผู้|ติดต่อ"),
        regex.compile(
            rf"(?V1)(?:{_THAI_TITLES})(?P<t>{_THAI}{{2,20}}?(?: (?!{_THAI_FOLLOW}){_THAI}{{2,20}}?)?)(?= ?(?:{_THAI_FOLLOW})|[^\S ]|[^\p{{Thai}} ]| [^\p{{Thai}}]|$| {_THAI})"
            rf"|(?:{_THAI_LABELS})(?:{_THAI_TITLES})?(?P<l>{_THAI}{{2,20}}(?: {_THAI}{{2,20}})?)(?![\p{{L}}\p{{M}}])"
        ),
    ),
    (
        re.compile(f"{_EAST_LABELS}|作者|联系人|负责人|審閲者|先生|女士|教授|博士|老师|小姐|同学|さん|氏|様"),
        regex.compile(
            rf"(?V1)(?:{_EAST_LABELS})(?P<l>{_EAST}{{2,8}}?)(?={_EAST_FOLLOW}|[^\p{{L}}\p{{M}}]|$)"
            rf"|(?:作者|联系人|负责人|審閲者)(?P<l>{_EAST_NAME}{{2,4}}?)(?=已|[，。、\s])"
            rf"|{_EAST_START}(?P<f>{_EAST_NAME}{{1,4}}?)(?=先生|女士|教授(?!法|学|了|的)|博士(?!生|后|学)|老师|小姐|同学(?!们))"
            rf"|{_EAST_START}(?P<f>{_EAST_NAME}{{2,6}}?)(?=さん|氏(?!名)|(?<![多仕同模異一])様(?![々子式]))"
        ),
    ),
]
_AFTER = regex.compile(rf"\s*(?:{_FOLLOW})(?![\p{{L}}\p{{M}}])|\s*(?:{_THAI_FOLLOW})|(?:{_EAST_FOLLOW})")
_FURTHER = regex.compile(rf"(?V1) ({_SPACED}+)(?![\p{{L}}\p{{M}}])")
_PART = regex.compile(r"[^ -]+")
_RUN_ONLY = regex.compile(rf"(?V1){_RUN}+")


def in_run(name: str) -> bool:
    """Whether the script of a name parts no words, so that it is looked for at every place."""
    return _RUN_ONLY.fullmatch(name) is not None


def led(form: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, group) of the names that a title, a label or a greeting shows."""
    for sign, places in _PLACES:
        if sign.search(form):
            for m in places.finditer(form):
                yield *m.span(m.lastgroup), m.lastgroup


def harvest(form: str) -> Iterator[tuple[str, bool]]:
    """(word, is given name) of the names shown; names of one letter are not learnt."""
    for a, b, _ in led(form):
        parts = _PART.findall(form[a:b])
        for k, part in enumerate(parts):
            if SHORT <= len(part) <= LONG:
                yield part, k == 0 and len(parts) > 1


def stretches(form: str, starts: frozenset[str] | None = None) -> Iterator[tuple[int, str]]:
    """(start, part) of every part of a stretch without blanks that could be a name.

    With ``starts`` only of the parts that begin with one of them.
    """
    for m in RUNS.finditer(form):
        run = m[0]
        for a in range(len(run) - SHORT + 1):
            if starts is not None and run[a : a + SHORT] not in starts:
                continue
            for n in range(min(LONG, len(run) - a), SHORT - 1, -1):
                yield m.start() + a, run[a : a + n]


def begins(names: Iterable[str]) -> frozenset[str]:
    """What the names start with that are looked for at every place."""
    return frozenset(name[:SHORT] for name in names if in_run(name))


def spans(form: str, known: Callable[[str], tuple[int, int] | None], starts: frozenset[str]) -> Iterator[tuple[int, int, tuple[int, int, int, int, int]]]:
    """(start, end, (known, titled, lead, follow, two words)) of the proposed names.

    ``starts`` are the beginnings (`begins`) of the known names of scripts without blanks.
    """
    used: list[tuple[int, int]] = []
    free = lambda a, b: all(b <= x or a >= y for x, y in used)
    follows = lambda b: _AFTER.match(form, b) is not None
    for a, b, group in led(form):
        if free(a, b):
            while (m := _FURTHER.match(form, b)) and known(m[1]) is not None and free(a, m.end()):
                b = m.end()
            used.append((a, b))
            parts = _PART.findall(form[a:b])
            hit = all(known(p) is not None for p in parts)
            yield a, b, (hit, group != "l", group == "l", follows(b), hit and len(parts) > 1)
    words = [(*m.span(), m[0]) for m in SPACED_WORD.finditer(form)]
    k = 0
    while k < len(words):
        a, b, word = words[k]
        k += 1
        if known(word) is None or not free(a, b):
            continue
        n = 1
        while n < 3 and k < len(words) and form[b : words[k][0]] in (" ", "-") and known(words[k][2]) is not None and free(a, words[k][1]):
            b, n, k = words[k][1], n + 1, k + 1
        yield a, b, (True, False, False, follows(b), n > 1)
    at = 0
    for a, part in stretches(form, starts):
        if a >= at and known(part) is not None and free(a, a + len(part)):
            at = a + len(part)
            yield a, at, (True, False, False, follows(at), False)
