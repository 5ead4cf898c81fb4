"""Personal information in free text: finding it and putting typed placeholders in its place.

Weak supervision. Patterns propose spans; regular expressions, a gazetteer harvested from
the corpus itself and labels beside a span vote on it, or abstain. Expectation maximisation
over the counts of all vote patterns of the corpus estimates how often each labeler is
right. Two more labelers are learnt: for every type, what stands left and right of spans
that are personal and of those that are not. A second estimation takes their votes in, and
a span classifier is trained on the resulting probabilities and applied to every span.

Spans are proposed on the consistent form of the text (see `unify`), so wide digits,
zero-width characters and look-alike letters do not hide anything; their places are then
taken back to the stored text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import caseless
from threadloom.llm.unify import unify
from threadloom.session import materialise

TYPES = ("email", "phone", "id_number", "address", "name")
EMAIL, PHONE, ID, ADDRESS, NAME = range(5)
#: Labelers that look at the text, and all of them: the contexts to the left and right vote as well.
STATIC, LABELERS = 7, 9
#: Spans of each type that the classifier is fitted on.
SAMPLE = 20_000
#: Above this many words the word table is joined instead of broadcast.
BROADCAST_NAMES = 500_000
DIMENSIONS = 1 << 14
#: Places of the tables of contexts; contexts that share a place share a vote.
CONTEXTS = 1 << 14

YES, NO = 1, 2
#: Characters before a place that a label can fill, after it, and that a feature looks at.
REACH = 64
#: A word is a name if so large a share of its capitalised uses is shown to be one, and so small a share of its uses has small letters.
LEAST_SHOWN, MOST_SMALL = 0.1, 0.1
NAME_WORD, COMMON_WORD, NEVER_SHOWN = range(3)
#: Uses without a shown one from which a capitalised word counts as no name.
FREQUENT = 50

_WORD = r"(?:\p{Lu}[’'])?\p{Lu}[\p{Ll}\p{M}]+(?:’\p{Lu}[\p{Ll}\p{M}]+)?"
_CAPS = r"\p{Lu}[\p{Lu}\p{M}]{2,}"
_PART = rf"(?:{_WORD}|{_CAPS})(?:-(?:{_WORD}|{_CAPS}))*"
_FREE = r"(?<![\p{Latin}\p{Cyrillic}\p{Greek}\p{M}\p{Nd}_@./\\+-])"
_DONE = r"(?![\p{Latin}\p{Cyrillic}\p{Greek}\p{M}\p{Nd}_@/\\=+(]|-\p{L}|\.[\p{Ll}\p{Nd}])"
_INITIALS = r"(?:\p{Lu}\. ?){1,3}"

# Words beside personal information in general, by language in no order of weight.
TITLES = (
    "Mr Mrs Ms Miss Dr Prof Professor Mme Mlle Monsieur Madame Herr Herrn Frau Pan Pani Panu prof dr Señor Señora Sr Sra Don Doña Sig Signora Dott Senhor Senhora Проф проф Д-р д-р Г-н डॉ"
    " Student Studentin Teilnehmer Teilnehmerin Uczestnik Uczestniczka Étudiant Étudiante Студент Студентка"
).split()
_GREETINGS = (
    r"Dear|Hi|Hello|Hey|Hallo|Liebe|Lieber|Geehrter?|Cześć|Drogi|Droga|Bonjour|Salut|Cher|Chère|Привет|Здравствуйте,?|Уважаем(?:ый|ая)|Hola|Estimad[oa]|Querid[oa]|Ciao|Car[oa]|Gentile|Olá"
    r"|(?:Thanks|Cheers|Best|Regards|Sincerely|Merci|Cordialement|Viele Grüße|Mit freundlichen Grüßen|Pozdrawiam|С уважением|Saludos|Saluti|Abraços),?\n"
)
_NAME_LABELS = (
    r"Authors?|Name|Contact|Reviewer|reviewer|Owner|From|To|Attn|Label|label|Assignee|Signed-off-by|Reported-by|Autor(?:in|ka)?|Kontakt|Ansprechpartner(?:in)?|Auteur|Автор|Контакт|Имя|Nombre|Nome|Faktura|Rechnung|Imię"
)
BEFORE_NAME = rf"{_GREETINGS}|(?:{_NAME_LABELS}) ?:|\"(?:owner|name|author|contact)\": ?\"|(?:name|owner|author)=|TODO\(|[Bb]y"
_SAYING = (
    r"said|says|wrote|writes|asked|asks|replied|reviewed|explained|told|called|et al\.|lives|fragte|sagte|schrieb|meinte|antwortete|nennt|prüft|napisała?|powiedziała?|zapytała?|sprawdziła?|badał[ai]?"
    r"|écrit|demande|répond|parle|explique|сказала?|написала?|спросила?|изучала?|проверила?|dijo|escribió|preguntó|ha detto|disse"
)
AFTER_NAME = rf",? (?:{_SAYING})\b|, (?:der|die|who|qui|który|która|который|которая|que|che) | <"
BEFORE_EMAIL = r"(?i:e-?mail|mailto|mail|contact|kontakt|contacto|courriel|correo|почта|пишите на|邮箱|写信到|メール|連絡先は|write to|cc|from|address|adres)[ \"<:=]*"
BEFORE_PHONE = r"(?i:call|phone|tele?|tél|telefon|téléphone|teléfono|telefono|sms|mobile|cell|fax|kom|handy|тел|телефон|звоните|电话|手机|電話は?|携帯|फ़ोन|फोन|هاتف|جوال|โทร|appelez le|number is|dzwonić)[ .:：=\"]*"
BEFORE_ID = (
    r"(?:[Pp]assports?(?: or SSN| number| no\.?)?|PASSPORT|SSN|[Ss]ocial [Ss]ecurity(?: [Nn]umber)?|PESEL|\bID|nr|Nr|[Dd]owód|Steuer-?ID|Ausweis(?:nummer)?|[Rr]eisepass|sécu|[Пп]аспорт|身份证号?|マイナンバー|NINO|ИНН|СНИЛС"
    r"|insurance number|tax number|DNI|NIE|NIF|CPF|RG|[Cc]odice [Ff]iscale|BSN|Aadhaar|هوية)[ .:：#№(=]*"
)
BEFORE_ADDRESS = r"(?:lives at|[Aa]ddress|near|at|to|adres|przy|[Aa]dresse|[Aa]nschrift|[Аа]дрес[^\n:]*|[Dd]irección|[Ii]ndirizzo|[Ee]ndereço|地址|住所|寄到|an|au|in)[ :：]*"
NOT_PERSONAL = r"(?:seeds?|[Ss]eeds|[Hh]ash|[Bb]atch|[Ss]hape|run id|step|tokens:?|[Ss]izes?|[Tt]iming|version|line|Section|loss|acc|ids|row|v|no\.|No\.|Nr\.|Fig\.|Eq\.|Sec\.)[ =:#(/,]*[\d ,]*"
_UNITS = r" ?(?:ids|Hz|kHz|MHz|ms|px|[kMG]?B|rows|steps|tokens|-B)(?!\p{L})"
#: A stop after an abbreviated street belongs to it; after "St" only where no sentence can end.
STREETS = r"(?:Street|Avenue|Road|Lane|Drive|Close|Court|Way|Square|Place|Terrace|Crescent|Boulevard)\b|(?:Ave|Rd|Ln|Dr|Ct|Sq|Pl|Blvd)\b\.?|St\b(?:\.(?=[,;]| \p{Ll}))?"

_CAP = r"\p{Lu}[\p{L}\p{M}’'-]+"
_LINK = r"(?:de la |de los |de las |de l’|de l'|della |delle |dei |del |dell’|di |da |do |dos |de |d’)?"
_TOWN = rf"{_CAP}(?: {_CAP}){{0,2}}"
_EN_CODE = r"(?:,? [A-Z]{2} \d{5}(?:-\d{4})?| [A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2})"
_GAP = r"(?:, ?\n?| ?\n)"
_ADDRESSES = [
    rf"\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}(?:{STREETS})(?:, (?:Flat|Apt|Apartment|Unit|Suite)\.? ?\w{{1,4}}\b)?(?:{_GAP}{_TOWN}{_EN_CODE}|, {_TOWN}(?=[.;,)\n]| [\p{{Ll}}]|$)|\n{_TOWN}(?=[.;)\n]| and |$))?",
    rf"(?:\p{{Lu}}[\p{{L}}\p{{M}}-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer|steig)|{_CAP} (?:Straße|Str\.|Gasse|Weg|Allee|Platz|Ring|Damm)|(?:Am|An der|Im|Zum|Zur|Auf dem|Unter den|In der) {_CAP}) \d{{1,4}}(?: ?[a-z]\b)?(?:{_GAP}\d{{5}} {_TOWN})?",
    rf"(?:ul\.|ulica|ulicy|al\.|aleja|alei|os\.|osiedle|pl\.|plac) {_CAP}(?: {_CAP}){{0,2}} \d{{1,4}}[A-Za-z]?(?:/\d+)?(?: m\. ?\d+)?(?:{_GAP}\d\d-\d{{3}} {_TOWN})?",
    rf"\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|av\.|bd|boulevard|impasse|place|chemin|allée|quai|cours)(?: (?:de la|de l’|de l'|du|des|de))? ?{_CAP}(?: (?:de |du |des )?{_CAP}){{0,3}}(?:{_GAP}\d{{5}} {_TOWN})?",
    rf"(?:ул\.|улица|пр\.|проспект|пер\.|пл\.|наб\.) {_CAP}(?: {_CAP}){{0,2}}, (?:д\. ?)?\d{{1,4}}[а-я]?(?:, кв\. ?\d+)?(?:, (?:г\. )?{_TOWN})?(?:, \d{{6}})?",
    r"(?:\p{Han}{2,3}省)?(?:(?<=[到至在于往：:，,。\s])\p{Han}{2,4}?|\p{Han}{2})[市县区镇]\p{Han}{2,6}?[路街道巷]\d+号(?:\d+号?楼)?(?:\d+单元)?(?:\d+室)?",
    rf"(?:Via|Viale|Piazza|Corso|Largo|Vicolo|Strada|Calle|C/|Avenida|Avda\.|Paseo|Plaza|Camino|Ronda|Carrer|Rua|Travessa|Praça) ?(?:das |dos )?{_LINK}{_CAP}(?: {_LINK}{_CAP}){{0,3}},? (?:n\.?[º°] ?)?\d{{1,4}}(?:[a-z]\b|/\d+|-\d+)?(?:, \d{{1,2}}[ºª°] ?[A-Z]?\b)?(?:{_GAP}(?:\d{{5}}|\d{{4}}-\d{{3}}) {_TOWN})?",
    rf"\p{{Lu}}[\p{{L}}\p{{M}}]*(?:straat|laan|gracht|plein|kade) \d{{1,4}}[a-zA-Z]?(?:{_GAP}\d{{4}} ?[A-Z]{{2}} {_TOWN})?",
    rf"(?:P\.? ?O\.? Box|Postfach|BP|Apartado(?: de Correos)?|Casella postale|Skrytka pocztowa|а/я) \d{{1,6}}(?:, {_TOWN}{_EN_CODE}|{_GAP}\d{{5}} {_TOWN})?",
    r"(?:\p{Han}{2,3}[都道府県])?\p{Han}{1,4}[市区町村][\p{Han}ノヶケのがァ-ヴ]{1,6}\d+(?:丁目)?(?:-\d+){1,3}",
]
ADDRESS_RE = regex.compile("|".join(f"(?<![\\p{{Latin}}\\p{{Cyrillic}}\\p{{Nd}}])(?:{a})" for a in _ADDRESSES))

_DOMAIN = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL_RE = regex.compile(
    rf"(?<![\p{{Latin}}\p{{Nd}}._%+/-])(?P<local>[A-Za-z0-9][A-Za-z0-9._%+-]*)(?P<at>[@＠]| ?[\[(] ?(?:at|AT) ?[\])] ?| (?:at|AT) )"
    rf"(?P<host>{_DOMAIN}(?:(?:\.| ?[\[(]?(?<=[ \[(])(?:dot|DOT)[\])]? ?){_DOMAIN})*(?:\.| ?[\[(]?(?<=[ \[(])(?:dot|DOT)[\])]? ?)[A-Za-z]{{2,24}})(?![A-Za-z0-9]|\.\w|-\w)"
)
#: Without one of these signs a text has no address of the pattern above.
_EMAIL_SIGN = re.compile(r"[@＠]|[\[(] ?(?:at|AT) ?[\])]|[A-Za-z0-9._%+-] (?:at|AT) [A-Za-z0-9](?:[A-Za-z0-9-]*\.[A-Za-z0-9]|.{0,80}(?:dot|DOT))")
NUMBER_RE = regex.compile(r"(?<![\p{Latin}\p{Nd}_.,:/+-])(?:\+|\(\+)?\(?\d(?:[ ().\-/]{0,2}\d){7,17}(?![\p{Latin}\p{Nd}_:/]|[-.,]\p{Nd}|-\p{L})")
PHONE_SHAPES = [
    r"(?:\+|00)[1-9]\d{0,2}[ .-]?(?:\(0\) ?)?\(?\d{1,4}\)?(?:[ .-]?\d{2,8}){1,5}",
    r"\(0?\d{2,4}\)[ -]?\d{3,4}[ -]?\d{4}", r"(?:1[-. ])?\(?[2-9]\d{2}\)?[-. ]\d{3}[-. ]\d{4}", r"0\d{2,4}[ .]\d{3,5}[ .]\d{3,4}",
    r"0\d(?:[ .-]?\d\d){4}", r"0\d{2,4}[ -]\d{5,8}", r"0\d{3} \d{3} \d{3}", r"\d{3} \d{3} \d{3}", r"0\d{9,10}", r"0\d{2,4}-\d{3,5}-\d{3,4}",
    r"0\d{2,4}\.\d{3,5}\.\d{3,4}", r"\(0\d{2,4}\) ?\d{3,5}[- ]\d{3,4}",
]
PHONE_SHAPE = regex.compile("|".join(f"(?:{p})" for p in PHONE_SHAPES))
_ID_LETTER, _ID_END = "[A-ZАВЕКМНОРСТУХ]", "[A-DАВС]"
_ID_SHAPES = [
    _ID_LETTER + r"{2} ?\d{2} ?\d{2} ?\d{2} ?" + _ID_END, _ID_LETTER + r"{2}\d{7}", _ID_LETTER + r"{3} ?\d{6}", r"\d{3}[- ]\d{2}[- ]\d{4}", r"\d{17}[\dXx]",
    r"\d{8}[A-Z]", r"[XYZ]\d{7}[A-Z]", r"\d{3}\.\d{3}\.\d{3}-\d{2}", r"[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]",
]
ID_STRONG = regex.compile("|".join(_ID_SHAPES))
#: Plain digits: a number of this kind only where something beside it says so.
_ID_DIGITS = [r"[1-8] ?\d{2} ?\d{2} ?\d[\dAB] ?\d{3} ?\d{3} ?\d{2}", r"\d{5} \d{3} \d{3}", r"\d{2} \d{3} \d{3} \d{3}", r"\d{11}", r"\d{9}"]
ID_RE = regex.compile(
    r"(?=[\dA-ZАВЕКМНОРСТУХ])(?<![\p{Latin}\p{Nd}_.,:/+-])(?:" + "|".join([*_ID_SHAPES, *_ID_DIGITS]) + r")(?![\p{Latin}\p{Nd}_:/]|[-.,]\p{Nd}|-\p{L})"
)
NAME_RE = regex.compile(rf"{_FREE}(?:(?<!\d ){_INITIALS}{_PART}|{_PART}(?:,? {_PART}){{0,3}}){_DONE}")
TOKEN_RE = regex.compile(_PART)
#: What stands before a place is matched backwards from it, so nothing is searched for.
_TITLE = regex.compile(rf"(?r)(?<!\p{{L}})(?:{'|'.join(TITLES)})\.? ?")
_BEFORE_NAME = regex.compile(rf"(?r)(?:{BEFORE_NAME})[ \n]*")
_AFTER_NAME = regex.compile(AFTER_NAME)
_LED = regex.compile(_INITIALS)
_SENTENCE_END = regex.compile(r"[.!?。:\n]\s*$")
_FRENCH = regex.compile(r"\b(?:la|le|les|une|des|du|parle|est|de)\s")
_BEFORE = {k: regex.compile(f"(?r){p}") for k, p in ((EMAIL, BEFORE_EMAIL), (PHONE, BEFORE_PHONE), (ID, BEFORE_ID), (ADDRESS, BEFORE_ADDRESS))}
_UNIT_AFTER = regex.compile(_UNITS)
#: An article before a capitalised word nobody has shown to be a name.
_ARTICLE = regex.compile(r"(?r)(?<![\p{L}\p{M}])(?i:the|an?|der|die|das|den|dem|des|ein|eine[nmrs]?|les?|la|une?|el|los|las|il|lo|gli|i|os|as|de|het) ")
_NOT = regex.compile(rf"(?r)(?<![\p{{L}}])(?:{NOT_PERSONAL})")

# ------------------------------------------------------------------ gazetteer

def _halves(token: str) -> list[str]:
    """The parts of a hyphenated token in title case, so that capitals do not matter."""
    return [p if not p.isupper() else p.capitalize() for p in token.split("-")]


# Pronouns that stand where names do.
_LEADING = (
    "Dear Hi Hello Hey Hallo Liebe Lieber Cześć Drogi Droga Bonjour Salut Cher Chère Привет Здравствуйте Hola Estimado Estimada Querido Querida Ciao Caro Cara Gentile Olá Thanks Cheers Best Regards"
    " Sincerely Merci Cordialement Grüße Pozdrawiam Saludos Saluti Abraços Author Authors Name Contact Reviewer Owner From To Attn Label Assignee Autor Autorin Autorka Kontakt Ansprechpartner"
    " Ansprechpartnerin Auteur Автор Контакт Имя Nombre Nome Faktura Rechnung Imię By"
).split()
_NO_PART = frozenset([*TITLES, *_LEADING]) | frozenset("I He She They We You It Who This That There Nobody Everyone Er Sie Wir Ich Es Il Elle On Nous Vous Ils Elles Ona Oni Он Она Они Мы Вы".split())

_PLAIN = regex.compile(r"(?<![\w@.+/\p{M}-])[\p{L}\p{M}]+(?![\w@+/\p{M}-]|\.\w)")


_COUNTS = ("first", "last", "capital", "small", "sure")


def _behind(form: str, at: int) -> bool:
    """Does a label, a greeting or the like end at a place?"""
    return _BEFORE_NAME.match(form, max(0, at - REACH), at) is not None


def _titled(form: str, at: int) -> bool:
    return _TITLE.match(form, max(0, at - REACH), at) is not None


def _shown_names(form: str) -> Iterator[tuple[list[str], list[bool], bool]]:
    """Names that stand where names stand: their parts, which of them are given names, and how sure.

    A title, a label or a greeting shows the one or two words after it, a word of saying
    the one or two before it; the latter is not sure, as it may be an object that stands
    there. Initials, and a title before one word, show a family name.
    """
    for m in NAME_RE.finditer(form):
        led = _LED.match(m[0])
        tokens = [(p.start() + m.start(), p.end() + m.start(), p[0]) for p in TOKEN_RE.finditer(m[0], pos=led.end() if led else 0)]
        starts = [m.start() if led and k == 0 else a for k, (a, _, _) in enumerate(tokens)]
        k = 0
        while k < len(tokens):
            titled = _titled(form, starts[k])
            if tokens[k][2] in _NO_PART or not (titled or _behind(form, starts[k])):
                k += 1
                continue
            gap = form[tokens[k][1] : tokens[k + 1][0]] if k + 1 < len(tokens) else ""
            n = 2 if gap in (" ", ", ") and gap else 1
            initials = led is not None and k == 0
            parts = [t for _, _, t in tokens[k : k + n]]
            yield parts, [not initials and ((x == 0) != (gap == ", ") if n > 1 else not titled) for x in range(n)], True
            k += n
            tokens, starts, led = tokens[k:], starts[k:], None
            k = 0
        if tokens and _AFTER_NAME.match(form, m.end()):
            parts = [t for _, _, t in tokens[-2:]] if len(tokens) > 1 and form[tokens[-2][1] : tokens[-1][0]] == " " else [tokens[-1][2]]
            initials = led is not None and len(tokens) == len(parts)
            yield parts, [not initials and x == 0 for x in range(len(parts))], led is not None


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list[int]] = {}
        words: Counter[str] = Counter()
        for text in batch["text"].to_pylist():
            form = unify(text)[0]
            for parts, first, sure in _shown_names(form):
                for k, part in enumerate(parts):
                    given = first[k] and not (part.isupper() and len(parts) > 1)
                    for h in () if part in _NO_PART else _halves(part):
                        c = counts.setdefault(h, [0] * 5)
                        c[0 if given else 1] += 1
                        c[4] += sure
            if caseless.ANY.search(form):
                for part, first in caseless.harvest(form):
                    c = counts.setdefault(part, [0] * 5)
                    c[0 if first else 1] += 1
                    c[4] += 1
                for w in caseless.SPACED_WORD.findall(form):
                    counts.setdefault(w, [0] * 5)[2] += 1
            words.update(_PLAIN.findall(form))
        for w, n in words.items():
            if w[0].isupper() or w.islower():
                title = w.capitalize() if w.isupper() else w[0].upper() + w[1:]
                counts.setdefault(title, [0] * 5)[2 if w[0].isupper() else 3] += n
        keys = list(counts)
        values = np.array(list(counts.values()), np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(values[:, k]) for k in range(5))], names=["token", *_COUNTS])


def _stretches(names: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch["text"].to_pylist():
                counts = Counter(part for _, part in caseless.stretches(unify(text)[0]) if names is None or part in names)
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["token", "uses"])

    return run


def gazetteer(docs: DataFrame, least_share: float = LEAST_SHOWN, most_small: float = MOST_SMALL, broadcast_names: int = BROADCAST_NAMES) -> DataFrame:
    """(token, first, last, level): what the corpus shows about its capitalised words.

    Level `NAME_WORD`: at least ``least_share`` of the capitalised uses, and two of them,
    stand where names stand, at least one of them surely, and the word is hardly used in
    small letters. ``first`` and ``last`` count these uses as a given and as a family name. `COMMON_WORD`: it is used
    in small letters. `NEVER_SHOWN`: `FREQUENT`, and hardly ever where names stand. Other
    words have no row. In scripts without case all uses count as capitalised, and only
    names have rows; in those without blanks every place that holds the name is a use, and
    these are counted in a second pass over the texts of such scripts.
    """
    found = docs.select("text").where("text IS NOT NULL").mapInArrow(_evidence, f"token string, {', '.join(f'{c} bigint' for c in _COUNTS)}")
    sums = found.groupBy("token").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    shown = F.col("first") + F.col("last")
    is_name = (F.col("sure") > 0) & (shown >= 2) & (shown >= least_share * F.col("capital")) & (F.col("small") <= most_small * F.col("capital"))
    level = (
        F.when(is_name, NAME_WORD)
        .when(F.col("small") > most_small * F.col("capital"), COMMON_WORD)
        .when((F.col("capital") >= FREQUENT) & (shown < 0.01 * F.col("capital")), NEVER_SHOWN)
    )
    in_run = F.col("token").rlike(f"^{caseless.RUN_JAVA}+$")
    caseless_word = F.col("token").rlike(caseless.ANY_JAVA)
    wanted = F.when(in_run, shown >= 2).otherwise((F.col("capital") > 0) & level.isNotNull() & (~caseless_word | (level == NAME_WORD)))
    candidates = materialise(sums.where(wanted).withColumn("level", level).withColumn("in_run", in_run))
    kept, runs = candidates.where(~F.col("in_run")).select("token", "first", "last", "level"), candidates.where("in_run")
    if n := runs.count():
        wanted = frozenset(r["token"] for r in runs.select("token").collect()) if n <= broadcast_names else None
        texts = docs.select("text").where(F.col("text").rlike(caseless.RUN_JAVA))
        uses = texts.mapInArrow(_stretches(wanted), "token string, uses bigint").join(runs.select("token"), "token").groupBy("token").agg(F.sum("uses").alias("uses"))
        named = runs.join(uses, "token").where(shown >= least_share * F.col("uses"))
        kept = kept.union(named.select("token", "first", "last", F.lit(NAME_WORD).alias("level")))
    return kept


# ---------------------------------------------------------------- proposals

@dataclass(slots=True)
class Span:
    kind: int
    start: int
    end: int
    votes: tuple[int, ...]


def _around(form: str, start: int, end: int) -> tuple[str, str]:
    return form[max(0, start - REACH) : start], form[end : end + REACH]


def _emails(form: str) -> Iterator[Span]:
    if _EMAIL_SIGN.search(form) is None:
        return
    for m in EMAIL_RE.finditer(form):
        before, after = _around(form, m.start(), m.end())
        host, at = m["host"], m["at"]
        spelled = at.strip(" ").lower() == "at"
        yield Span(EMAIL, m.start(), m.end(), (
            YES if "@" in at or "＠" in at else 0,
            YES if regex.search(r"[\[(]", at) else 0,
            YES if regex.search(r"dot", host, regex.I) else 0,
            YES if regex.search(r"[._+\d-]", m["local"]) else 0,
            YES if _BEFORE[EMAIL].match(before) else 0,
            NO if after[:1] == "/" or before.endswith("/") or (spelled and not regex.search(r"[._+\d-]", m["local"]) and "dot" not in host) else 0,
            NO if regex.search(r"\.(?:py|js|md|txt|log|json|bin|html?|csv|bak)$", host) else 0,
        ))


def _numbers(form: str) -> Iterator[Span]:
    for m in NUMBER_RE.finditer(form):
        start, end = m.start(), m.end()
        value = m[0]
        if value.startswith("(") and ")" not in value:
            start += 1
        value = form[start:end]
        before, after = _around(form, start, end)
        digits = sum(c.isdigit() for c in value)
        shape = PHONE_SHAPE.fullmatch(value)
        identity = _BEFORE[ID].match(before)
        yield Span(PHONE, start, end, (
            YES if regex.match(r"\+|00[1-9]", value) and 9 <= digits <= 15 else 0,
            YES if shape else NO,
            NO if identity else YES if _BEFORE[PHONE].match(before) else 0,
            NO if _NOT.match(before) or _UNIT_AFTER.match(after) else 0,
            YES if 9 <= digits <= 14 else NO,
            NO if identity or ID_STRONG.fullmatch(value) else 0,
            YES if regex.search(r"[ ().-]", value) else 0,
        ))
    for m in ID_RE.finditer(form):
        before, after = _around(form, m.start(), m.end())
        value = m[0]
        strong, labelled = ID_STRONG.fullmatch(value) is not None, _BEFORE[ID].match(before) is not None
        yield Span(ID, m.start(), m.end(), (
            YES if strong else 0,
            YES if labelled else 0,
            YES if regex.search(r"[A-ZА-Я]", value) else 0,
            NO if not labelled and (_NOT.match(before) or _UNIT_AFTER.match(after)) else 0,
            NO if not labelled and _BEFORE[PHONE].match(before) else 0,
            NO if value.isdigit() and not labelled else 0,
            NO if not labelled and not strong and PHONE_SHAPE.fullmatch(value) else 0,
        ))


def _addresses(form: str) -> Iterator[Span]:
    for m in ADDRESS_RE.finditer(form):
        before, after = _around(form, m.start(), m.end())
        value = m[0]
        yield Span(ADDRESS, m.start(), m.end(), (
            YES,
            YES if regex.search(r"\d{5}|\d\d-\d{3}|[A-Z]\d{1,2} \d[A-Z]{2}|室|, (?:Flat|Apt)| m\. |кв\.", value) else 0,
            YES if regex.search(r"[,\n] ?\p{Lu}\p{Ll}+", value) else 0,
            YES if _BEFORE[ADDRESS].match(before) else 0,
            NO if regex.search(r"(?:line|Section|row|step) ?$|\(\) at", before) else 0,
            YES if regex.match(r"[;).,\n]|$", after) else 0,
            NO if regex.search(r"[_=]", value) else 0,
        ))


class Words:
    """The word table as the proposals ask it: name counts of a word, or what else it is."""

    def __init__(self, rows: dict[str, tuple[int, int, int]]) -> None:
        self.get = rows.get
        self.starts = caseless.begins(w for w, row in rows.items() if row[2] == NAME_WORD)

    @classmethod
    def of(cls, hits: list | None) -> Words:
        return cls({x["token"]: (x["first"], x["last"], x["level"]) for x in hits or []})

    def known(self, word: str) -> tuple[int, int] | None:
        row = self.get(word)
        return row[:2] if row is not None and row[2] == NAME_WORD else None

    def level(self, token: str) -> int | None:
        """Of the parts of a hyphenated token the one that says most against a name."""
        levels = [row[2] for h in _halves(token) if (row := self.get(h)) is not None]
        return COMMON_WORD if COMMON_WORD in levels else max(levels, default=None)


#: Capitals of an acronym at most; longer words of capitals may be family names.
ACRONYM = 4


def _acronym(word: str) -> bool:
    return word.isupper() and len(word) <= ACRONYM


def _names(form: str, words: Words, taken: list[tuple[int, int]]) -> Iterator[Span]:
    """Names outside ``taken``, the places of addresses.

    Known names, alone or in twos, what a title, a label or a word of saying shows, runs of
    words the corpus knows nothing about, and single ones inside a sentence.
    """
    for m in NAME_RE.finditer(form):
        led = _LED.match(m[0])
        info = []
        for p in TOKEN_RE.finditer(m[0], pos=led.end() if led else 0):
            hits = [words.known(h) for h in _halves(p[0])]
            hit = None if None in hits else (sum(h[0] for h in hits), sum(h[1] for h in hits))
            new = hit is None and p[0] not in _NO_PART and words.level(p[0]) is None
            info.append((p.start() + m.start(), p.end() + m.start(), p[0], hit, new))
        k = 0
        while k < len(info):
            a, b, token, hit, new = info[k]
            if token in _NO_PART or any(x <= a < y for x, y in taken):
                k += 1
                continue
            start, end, n = a, b, 1
            initials = bool(led) and k == 0
            if initials:
                start = m.start()
            nxt = info[k + 1] if k + 1 < len(info) else None
            gap = form[b : nxt[0]] if nxt else ""
            if nxt and not initials:
                given, family = (hit or (0, 0)), (nxt[3] or (0, 0))
                swapped = hit is not None and nxt[3] is not None and (token.isupper() or given[1] >= given[0]) and family[0] > family[1]
                if gap == " " and hit is not None and nxt[3] is not None or gap == ", " and swapped and not token.isspace() and given[1] > given[0]:
                    end, n = nxt[1], 2
                elif gap == " " and hit is not None and given[0] > given[1] and nxt[2] not in _NO_PART:
                    end, n = nxt[1], 2
                elif gap == " " and new and token.isupper() and len(token) > ACRONYM and family[0] > family[1]:
                    end, n = nxt[1], 2
                elif gap == " " and new and not _acronym(token) and (nxt[4] and not _acronym(nxt[2]) or family[1] > family[0]):
                    end, n = nxt[1], 2
                    while n < 4 and k + n < len(info) and info[k + n][4] and not _acronym(info[k + n][2]) and form[end : info[k + n][0]] == " ":
                        end, n = info[k + n][1], n + 1
            k += n
            if initials and m[0].startswith("M.") and _FRENCH.search(form, end, end + 32):
                start = m.start() + (3 if m[0][2:3] == " " else 2)
                initials, titled = start < a, True
            else:
                titled = _titled(form, start)
            lead, follow = _behind(form, start), _AFTER_NAME.match(form, end) is not None
            sentence_start = _SENTENCE_END.search(form, max(0, start - 8), start) is not None or start == 0
            shown = titled or lead or follow or initials
            if hit is None and not (shown or n > 1 or new and not sentence_start and not token.isupper()):
                continue
            run = n > 1 and hit is None
            against = hit is None and not titled and (n == 1 and (sentence_start or not new) or form[start:end].isupper() or not initials and _ARTICLE.match(form, max(0, start - 8), start) is not None)
            yield Span(NAME, start, end, (
                YES if hit is not None else 0 if titled or initials or run else NO,
                YES if titled else 0,
                YES if lead else 0,
                YES if follow else 0,
                YES if initials else 0,
                YES if n > 1 else 0,
                NO if against else 0,
            ))
    if caseless.ANY.search(form) is None:
        return
    for start, end, (hit, titled, lead, follow, two) in caseless.spans(form, words.known, words.starts):
        yield Span(NAME, start, end, (YES if hit else 0 if titled else NO, YES if titled else 0, YES if lead else 0, YES if follow else 0, 0, YES if two else 0, 0))


def propose(form: str, words: Words) -> list[Span]:
    """All proposed spans of a text in its consistent form; they may overlap."""
    addresses = list(_addresses(form))
    return [*_emails(form), *_numbers(form), *addresses, *_names(form, words, [(s.start, s.end) for s in addresses])]


@lru_cache(maxsize=1 << 16)
def _slot(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % DIMENSIONS


def _shape(value: str) -> str:
    kinds = ["9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else " " if c.isspace() else c for c in value[:60]]
    return "".join(c for k, c in enumerate(kinds) if k < 2 or c != kinds[k - 1] or c != kinds[k - 2])


_LAST = regex.compile(r"(?r)([\p{L}\p{M}]+|[^\s])[^\S\n]*(\n?)\s*")
_NEXT = regex.compile(r"(\s*)([\p{L}\p{M}]+|[^\s])")


def beside(form: str, s: Span) -> tuple[str, str, str, str]:
    """The word or sign before a span and the one after it, and both contexts with what parts them.

    A sign beside a span, such as a comma or a colon, brings the word behind it along.
    """
    last, nxt = _LAST.match(form, max(0, s.start - REACH), s.start), _NEXT.match(form, s.end, s.end + REACH)
    before, left = (last[1].lower(), f"{last[1].lower()}{last[2]}") if last else ("", "")
    if last and not before[0].isalnum() and (more := _LAST.match(form, max(0, s.start - REACH), last.start())):
        left = f"{more[1].lower()}{left}"
    after, right = (nxt[2].lower(), f"{nxt[1][:1]}{nxt[2].lower()}") if nxt else ("", "")
    if nxt and not after[0].isalnum() and (more := _NEXT.match(form, nxt.end(), s.end + REACH)):
        right += more[2].lower()
    return before, after, left, right


def features(form: str, s: Span, before: str, after: str) -> list[int]:
    """Hashed features of a span but for its votes: its shape, its length and what is beside it."""
    return [_slot(f"{s.kind}|{f}") for f in ("b", f"p={before}", f"n={after}", f"s={_shape(form[s.start : s.end])}", f"l={min(s.end - s.start, 30) // 3}")]


@lru_cache(maxsize=1 << 16)
def vote_features(kind: int, votes: int) -> tuple[int, ...]:
    """Hashed features of a pattern of votes: each vote, and the whole pattern."""
    each = [(k, votes // 3**k % 3) for k in range(LABELERS)]
    return tuple(_slot(f"{kind}|v{k}={v}") for k, v in each if v)


# ------------------------------------------------------------------- training

def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: tuple[float, float] = (8.0, 2.0)) -> tuple[np.ndarray, np.ndarray]:
    """How often each labeler is right, by expectation maximisation over vote patterns.

    ``patterns`` (n x labelers) with 0 abstain, 1 yes, 2 no, ``counts`` their frequencies.
    A labeler that does not abstain is right with a probability of its own; abstentions say
    nothing. ``prior`` are the right and wrong votes each labeler starts with, which tells
    the two classes apart; both classes count as equally frequent beforehand, since spans
    on which one labeler votes alone could not tell a rare class from a poor labeler.
    Labelers that vote on the same spans tell each other's reliability; one that never
    meets another keeps that of the prior. Returns the probability of each pattern being
    personal and the probability of each labeler being right.
    """
    yes, no = patterns == YES, patterns == NO
    right = np.full(patterns.shape[1], prior[0] / sum(prior))
    votes = ((yes | no) * counts[:, None]).sum(0)
    post = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        weight = np.log(right) - np.log1p(-right)
        post = 1 / (1 + np.exp(-np.clip((yes * weight).sum(1) - (no * weight).sum(1), -40, 40)))
        agree = ((yes * post[:, None] + no * (1 - post)[:, None]) * counts[:, None]).sum(0)
        right = np.clip((agree + prior[0]) / (votes + sum(prior)), 1e-3, 1 - 1e-3)
    return post, right


def fit_classifier(feats: list[list[int]], target: np.ndarray, rounds: int = 300, l2: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on hashed features and soft targets, by AdaGrad.

    Rows with equal features are fitted as one with their mean target and their number.
    """
    groups: dict[tuple[int, ...], list[float]] = {}
    for f, y in zip(feats, target.tolist(), strict=True):
        row = groups.setdefault(tuple(f), [0.0, 0.0])
        row[0] += 1
        row[1] += y
    n, total = np.array(list(groups.values())).reshape(-1, 2).T
    target, share = total / np.maximum(n, 1), n / max(n.sum(), 1)
    width = max(map(len, groups), default=1)
    grid = np.full((len(groups), width), DIMENSIONS, np.int64)
    for k, f in enumerate(groups):
        grid[k, : len(f)] = f
    w, g2 = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[grid].sum(1), -30, 30)))
        g = np.bincount(grid.ravel(), weights=np.repeat((p - target) * share, width), minlength=DIMENSIONS + 1) + l2 * w / 100
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        w[DIMENSIONS] = 0.0
    return w[:DIMENSIONS].astype(np.float32)


@dataclass
class Model:
    """What the detector needs on every worker; its size does not depend on the corpus.

    ``names`` is the word table while it is small enough to be broadcast, else None.
    ``contexts`` has the votes of the left and right contexts of each type by their places.
    ``report`` has a row for each type: spans, decisions that the estimation changed against
    a plain count of votes, and decisions that the classifier changed against the estimation.
    """

    weights: np.ndarray
    contexts: np.ndarray
    reliability: dict[str, np.ndarray]
    names: dict[str, tuple[int, int, int]] | None
    report: list[tuple[str, int, int, int]] = field(default_factory=list)


def _capitals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tokens = [], []
        for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            form = unify(text)[0] if text else ""
            found = {h for t in TOKEN_RE.findall(form) for h in _halves(t)}
            if caseless.ANY.search(form):
                found |= {*caseless.SPACED_WORD.findall(form), *(part for _, part in caseless.stretches(form))}
            tokens += found
            ids += [i] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.string())], names=["id", "token"])


def _with_names(docs: DataFrame, names: DataFrame, small: bool) -> DataFrame:
    """Rows (id, text, hits): with a large gazetteer the names that each text holds.

    Capitalised words, and all possible names in scripts without case, are joined with the
    gazetteer by word, salted because a few words stand in most texts, and the hits of a
    text are brought back to it by id.
    """
    rows = docs.select("id", "text")
    if small:
        return rows.withColumn("hits", F.lit(None).cast("array<struct<token:string,first:bigint,last:bigint,level:int>>"))
    salts = 16
    words = rows.mapInArrow(_capitals, "id bigint, token string").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    salted = names.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(salts)])))
    hits = words.join(salted, ["token", "salt"]).groupBy("id").agg(F.collect_set(F.struct("token", "first", "last", "level")).alias("hits"))
    return rows.join(hits, "id", "left")


_SPANS = "spans array<struct<kind:int,start:int,end:int,votes:bigint,feats:array<int>,lc:int,rc:int,draw:bigint>>"
_SPAN = pa.list_(
    pa.struct(
        [
            ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.int64()), ("feats", pa.list_(pa.int32())), ("lc", pa.int32()), ("rc", pa.int32()), ("draw", pa.int64()),
        ]
    )
)


@lru_cache(maxsize=1 << 16)
def _context(words: str) -> int:
    return xxhash.xxh32_intdigest(words) % CONTEXTS


def _proposed(text: str, key, words: Words) -> list[dict]:
    """Proposed spans of a text with their places in the stored text, votes and features."""
    form, places = unify(text)
    out = []
    for s in propose(form, words):
        start, end = (s.start, s.end) if places is None else (places[s.start], places[s.end - 1] + 1)
        votes = sum(v * 3**k for k, v in enumerate(s.votes))
        draw = xxhash.xxh64_intdigest(f"{key}|{start}|{s.kind}") >> 34
        before, after, left, right = beside(form, s)
        feats = features(form, s, before, after)
        out.append({"kind": s.kind, "start": start, "end": end, "votes": votes, "feats": feats, "lc": _context(left), "rc": _context(right), "draw": draw})
    return out


def _proposals(names: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = Words(names) if names is not None else None
        for batch in batches:
            rows = []
            for i, text, hits in zip(*(batch[c].to_pylist() for c in ("id", "text", "hits")), strict=True):
                if text and (spans := _proposed(text, i, everywhere or Words.of(hits))):
                    rows.append((i, spans))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], _SPAN)], names=["id", "spans"])

    return run


def _digits(codes: list[int], n: int) -> np.ndarray:
    return np.array([[v // 3**k % 3 for k in range(n)] for v in codes]).reshape(-1, n)


def _estimate(counted: list[tuple[int, int, float]], n: int) -> tuple[dict[tuple[int, int], float], dict[str, np.ndarray]]:
    """Probability of every (kind, votes), and the reliabilities of each type's labelers."""
    post, reliability = {}, {}
    for kind, label in enumerate(TYPES):
        mine = sorted((v, c) for k, v, c in counted if k == kind)
        if mine:
            p, reliability[label] = em(_digits([v for v, _ in mine], n), np.array([c for _, c in mine], float))
            post |= {(kind, v): float(x) for (v, _), x in zip(mine, p, strict=True)}
    return post, reliability


#: Spans a context must have been seen with, and the least share of its class, to vote.
CONTEXT_SEEN, CONTEXT_SURE = 5, 0.9


def context_votes(spans: DataFrame, post: dict[tuple[int, int], float]) -> np.ndarray:
    """Votes (kinds x 2 x CONTEXTS) of the contexts to the left and right of all spans.

    A context votes as the spans beside it were estimated from their other labelers, over
    the whole corpus. The sums have at most kinds * 2 * CONTEXTS rows, whatever its size.
    """
    rows = [(k, v, p) for (k, v), p in post.items()]
    table = spans.sparkSession.createDataFrame(rows or [(-1, -1, 0.0)], "kind int, votes bigint, p double")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("lc").alias("at")), F.struct(F.lit(1).alias("side"), F.col("rc").alias("at")))).alias("c")
    known = spans.join(F.broadcast(table), ["kind", "votes"]).select("kind", "p", sides)
    sums = known.groupBy("kind", "c.side", "c.at").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= CONTEXT_SEEN).collect()
    out = np.zeros((len(TYPES), 2, CONTEXTS), np.int8)
    for r in sums:
        share = r["p"] / r["n"]
        out[r["kind"], r["side"], r["at"]] = YES if share >= CONTEXT_SURE else NO if share <= 1 - CONTEXT_SURE else 0
    return out


def _with_contexts(contexts: np.ndarray, kind: int, votes: int, left: int, right: int) -> int:
    return votes + 3**STATIC * int(contexts[kind, 0, left]) + 3 ** (STATIC + 1) * int(contexts[kind, 1, right])


def _voted(contexts: np.ndarray):
    """Adds the votes of the contexts to a column of spans (kind, votes, lc, rc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, votes, left, right = (b[c].to_numpy() for c in ("kind", "votes", "lc", "rc"))
            full = votes + 3**STATIC * contexts[kind, 0, left].astype(np.int64) + 3 ** (STATIC + 1) * contexts[kind, 1, right].astype(np.int64)
            yield pa.RecordBatch.from_arrays([b["kind"], pa.array(full), b["feats"], b["draw"]], names=["kind", "votes", "feats", "draw"])

    return run


def _count_of_votes(votes: int) -> bool:
    """What a plain count of the votes of the fixed labelers decides: more for than against."""
    each = [votes // 3**k % 3 for k in range(STATIC)]
    return each.count(YES) > each.count(NO)


def train(docs: DataFrame, sample: int = SAMPLE, broadcast_names: int = BROADCAST_NAMES) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the word table and the proposed spans of a corpus of rows (id, text).

    The word table, the contexts and the counts of vote patterns cover all texts; there are
    at most 3 ** 9 patterns of a type, so their table is bounded. The classifier is fitted
    on about ``sample`` spans a type, chosen by a hash (the number varies around ``sample``
    by its square root). Proposals are (id, spans) for texts with any; they are written once.
    """
    names = materialise(gazetteer(docs, broadcast_names=broadcast_names))
    small = names.count() <= broadcast_names
    known = {r["token"]: (r["first"], r["last"], r["level"]) for r in names.collect()} if small else None
    proposals = materialise(_with_names(docs, names, small).where("text IS NOT NULL").mapInArrow(_proposals(known), f"id bigint, {_SPANS}"))
    spans = proposals.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.feats", "s.lc", "s.rc", "s.draw")
    count = lambda df: [tuple(r) for r in df.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()]
    contexts = context_votes(spans, _estimate(count(spans), STATIC)[0])
    voted = spans.mapInArrow(_voted(contexts), "kind int, votes bigint, feats array<int>, draw bigint")
    counted = count(voted)
    post, reliability = _estimate(counted, LABELERS)
    weights = np.zeros(DIMENSIONS, np.float32)
    report = []
    total = [sum(n for k, _, n in counted if k == kind) for kind in range(len(TYPES))]
    few = F.coalesce(*[F.when(F.col("kind") == k, F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 30)))) for k, n in enumerate(total)])
    chosen = sorted(voted.where(F.col("draw") < few).select("kind", "draw", "votes", "feats").collect())
    for kind, label in enumerate(TYPES):
        mine = [r for r in chosen if r["kind"] == kind]
        changed = sum(n for k, v, n in counted if k == kind and (post[k, v] > 0.5) != _count_of_votes(v))
        other = 0
        if mine:
            feats = [[*r["feats"], *vote_features(kind, r["votes"])] for r in mine]
            target = np.array([post[kind, r["votes"]] for r in mine])
            own = fit_classifier(feats, target)
            weights += own
            other = sum((float(own[f].sum()) > 0) != (t > 0.5) for f, t in zip(feats, target, strict=True))
        report.append((label, total[kind], changed, round(other * total[kind] / max(len(mine), 1))))
    return Model(weights, contexts, reliability, known, report), names, proposals


# ------------------------------------------------------------------ detection

_ORDER = {EMAIL: 0, ADDRESS: 1, ID: 2, PHONE: 2, NAME: 3}


def choose(spans: list[dict], model: Model) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the personal spans among the proposed ones, without overlaps.

    Of overlapping spans the one whose type is more specific counts (email, address, number,
    name), then the more probable, then the longer.
    """
    kept = []
    for s in spans:
        votes = _with_contexts(model.contexts, s["kind"], s["votes"], s["lc"], s["rc"])
        score = float(model.weights[[*s["feats"], *vote_features(s["kind"], votes)]].sum())
        if score > 0:
            kept.append((_ORDER[s["kind"]], -score, s["start"] - s["end"], s["kind"], s["start"], s["end"]))
    taken: list[tuple[int, int, int]] = []
    for *_, kind, start, end in sorted(kept):
        if all(end <= a or start >= b for _, a, b in taken):
            taken.append((kind, start, end))
    return sorted(taken, key=lambda t: t[1])


def find(text: str, model: Model, words: Words) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the personal information of a text, in order."""
    return choose(_proposed(text, 0, words), model)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for kind, start, end in spans:
        out += [text[at:start], f"[{TYPES[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _found(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *t) for i, spans in zip(batch["id"].to_pylist(), batch["spans"].to_pylist(), strict=True) for t in choose(spans, model)]
            ids, kinds, starts, ends = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([TYPES[k] for k in kinds], pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                names=["id", "pii_type", "start_pos", "end_pos"],
            )

    return run


def _redacted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, choose(spans, model) if t and spans else []) for t, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True)]
            texts = [t if not s else redact(t, s) for t, s in rows]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string()), pa.array([len(s) for _, s in rows], pa.int32())], names=["id", "text", "n_found"])

    return run


def _searched(docs: DataFrame, model: Model, names: DataFrame) -> DataFrame:
    rows = _with_names(docs, names, model.names is not None).where("text IS NOT NULL")
    return rows.mapInArrow(_proposals(model.names), f"id bigint, {_SPANS}")


def find_personal(docs: DataFrame, model: Model, names: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """(id, pii_type, start_pos, end_pos) of every mention in rows (id, text).

    Positions count code points of the stored text, the end exclusive. NULL and empty
    texts have no rows; repeated rows are searched one by one. The ``proposals`` of `train`
    spare a second search of the corpus the model was trained on.
    """
    proposals = _searched(docs, model, names) if proposals is None else proposals
    slim = replace(model, names=None)
    return proposals.mapInArrow(_found(slim), "id bigint, pii_type string, start_pos int, end_pos int")


def replace_personal(docs: DataFrame, model: Model, names: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """(id, text, n_found): each text with `[EMAIL]`, `[NAME]`, ... in place of mentions.

    Ids must be distinct if ``proposals`` are given; they are joined to the texts by id.
    """
    if proposals is None:
        rows = _with_names(docs, names, model.names is not None)
        return rows.mapInArrow(_redacted_whole(model), "id bigint, text string, n_found int")
    rows = docs.select("id", "text").join(proposals.select("id", "spans"), "id", "left")
    return rows.mapInArrow(_redacted(replace(model, names=None)), "id bigint, text string, n_found int")


def _redacted_whole(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = Words(model.names) if model.names is not None else None
        for batch in batches:
            rows = [(t, find(t, model, everywhere or Words.of(hits)) if t else []) for t, hits in zip(batch["text"].to_pylist(), batch["hits"].to_pylist(), strict=True)]
            texts = [t if not s else redact(t, s) for t, s in rows]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string()), pa.array([len(s) for _, s in rows], pa.int32())], names=["id", "text", "n_found"])

    return run
