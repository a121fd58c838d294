"""Problem 7: personal details in free text, found by weakly supervised span classifiers and replaced."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import exp
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.messages import messages
from ..session import checkpoint_dir, spread

#: Read no more, as names and weights come from all messages; a test sets it.
SAMPLE_MESSAGES = 20_000
#: More candidates of a type weigh as much as so many against the weights before training, so that a larger table is judged alike.
MOST_WEIGHT = 300
#: Up to so many names, of up to so many characters in all, are sent to the executors; more meet the words of each message by a join.
MOST_NAMES, MOST_NAME_CHARS = 500_000, 8_000_000
TYPES = ("email", "phone", "id_number", "address", "name")

_CAP = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:['’-][A-ZÀ-Ý]?[a-zß-öø-ÿ]+)*"
_EMAIL = re.compile(
    r"(?<![\w.+/@-])[A-Za-z0-9][\w.+'-]*\s?(?:@|\[at\]|\(at\)|\{at\}|(?<=\w) at (?=[\w-]+ (?:dot|\.) ))\s?"
    r"[A-Za-z0-9-]+(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?|(?<=\w) dot )[A-Za-z0-9-]+)*",
    re.I,
)
_PHONE = re.compile(r"(?<![\w.+/=-])(?:\+|00)?\(?\d{1,4}\)?(?:[ .\-/]?\(?\d{1,5}\)?){1,6}(?![\w]|[.\-/:]\d|-\w)")
_ID_WORDS = (
    r"SSN|social security (?:number|no\.?)|passport(?: (?:number|no\.?))?|national insurance(?: (?:number|no\.?))?|driv(?:ing|er'?s?) licen[cs]e(?: (?:number|no\.?))?|"
    r"tax(?:payer)? (?:id|number|no\.?)|identity (?:card|number)(?: no\.?)?|id card(?: (?:number|no\.?))?|DNI|NIE|NIF|CPF|CNPJ|RG|NISS|Steuer-?ID(?:nummer)?|Steuernummer|"
    r"Personalausweis(?:nummer)?|Sozialversicherungsnummer|Reisepass(?:nummer)?|codice fiscale|carta d'identità|num[eé]ro de s[eé]curit[eé] sociale|num[eé]ro fiscal|"
    r"pasaporte|passeport|passaporte|passaporto|número de (?:identidad|identificación|segurança social|contribuinte)|ИНН|СНИЛС|паспорт|身份证(?:号码?)?|护照(?:号码?)?|マイナンバー|旅券番号"
)
_ID_NAMED = re.compile(rf"(?:\b|(?<=[^\w]))(?P<word>{_ID_WORDS})(?:\s*(?:n[º°o]\.?|nr\.?|#|is|ist|es|est|è|é|是|は))?(?:\s*[:：]\s*|\s+|(?<=[一-鿿ァ-ヿ]))(?P<value>[A-Z]{{0,6}}[ -]?\d[\dA-Z]*(?:[ .\-/][\dA-Z]+)*)", re.I)
_ID_SHAPE = re.compile(
    r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{8}-?[A-HJ-NP-TV-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|"
    r"[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2})(?![\w-])"
)
_PLACE = rf"(?:{_CAP}|[A-ZÀ-Þ]{{3,}})(?:[ -](?:{_CAP}|de|del|la|le|les|sur|am|an|der|di|do|da|[A-ZÀ-Þ]{{3,}})){{0,3}}"
_STREET_EN = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Close|Drive|Dr\.?|Court|Ct\.?|Place|Square|Way|Terrace|Boulevard|Blvd\.?|Crescent|Grove|Hill|Row|Mews|Parkway|Pkwy\.?)"
_UNIT = r"(?:Apt|Apartment|Flat|Unit|Suite|Ste|Room|Floor)\.? \w+"
_GAP = r"(?:,[ \n]|\n|,? - |[ ]\|[ ]|;[ ])"
_ADDRESSES = {
    "en": re.compile(
        rf"(?<![\w-])(?:{_UNIT},? )?\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,4}}{_STREET_EN}(?![a-z])(?:{_GAP}{_UNIT})?"
        rf"(?:{_GAP}{_PLACE})?(?:(?:{_GAP}| )(?:[A-Z]{{2}} )?(?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}}))?(?![\w-])"
    ),
    "romance": re.compile(
        rf"(?<!\w)(?:Calle|C/|Avenida|Avda\.?|Paseo|Plaza|Camino|Carretera|Travesía|Ronda|Via|Viale|Piazza|Corso|Vicolo|Largo|Strada|Rua|Travessa|Praça|Estrada|Alameda|Av\.)"
        rf" (?:(?:de|del|de la|de los|da|do|dos|das|della|dei|di) )?{_PLACE},? (?:n[º°.]? ?)?\d{{1,5}}[A-Za-z]?(?:,? (?:\d{{1,2}}[ºª°] ?\w?|bis))?"
        rf"(?:{_GAP}\d{{4,5}}(?:-\d{{3}})?(?: {_PLACE})?|{_GAP}{_PLACE})?(?![\w-])"
    ),
    "french": re.compile(
        rf"(?<![\w-])\d{{1,5}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd|chemin|place|allée|impasse|quai|route|cours|square|passage|sentier)"
        rf" (?:(?:de la|de l'|de l’|du|des|de|d'|d’|le|la|les) ?)?{_PLACE}(?:{_GAP}\d{{5}}(?: {_PLACE})?)?(?![\w-])",
    ),
    "german": re.compile(
        rf"(?<![\w-])(?:[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|pfad|markt|hof|chaussee)|(?:Am|An der|Auf dem|Im|In der|Zum|Zur|Unter den|Alte|Neue|Hinter der) "
        rf"{_CAP}(?: {_CAP})?(?:straße|weg)?|{_CAP} (?:Straße|Weg|Platz|Allee|Gasse)) \d{{1,4}}[a-z]?(?:{_GAP}\d{{5}}(?: {_PLACE})?)?(?![\w-])"
    ),
    "cjk": re.compile(r"(?:[一-鿿]{2,8}(?:省|市|区|县|都|府|県|町|村)){1,4}[一-鿿\w\d・-]{0,20}?(?:路|街|道|巷|丁目|番地|号)\d*[号室-]*\d*"),
    "russian": re.compile(r"(?:ул\.|улица|пр\.|проспект|пер\.|переулок|ш\.|шоссе|наб\.)\s[А-ЯЁ][А-Яа-яё -]+?,?\s(?:д\.|дом)?\s?\d+[а-я]?(?:,\s?кв\.?\s?\d+)?(?:,\s\d{6})?(?:,?\s[А-ЯЁ][а-яё-]+)?"),
}
_CAPITAL, _SMALL = "[A-ZÀ-ÖØ-Þ]", "[a-zß-öø-ÿ]"
_NAME = re.compile(
    rf"{_CAPITAL}(?<![\w@.+/-].)(?:{_SMALL}+(?:['’-][A-ZÀ-Ý]?{_SMALL}+)*(?:[ \t]+(?:{_CAP}|[A-Z]\.|van|von|de|da|di|del))*(?![\w@(]|\.\w|/|-\w)|(?<=[A-Z])[A-Z]{{2,}}(?: [A-Z]{{3,}})?(?![\w@]))"
)
_SMALL_NAME = re.compile(r"(?<=[Hh]i )[a-z]+(?=,)")
#: Names in small letters where people introduce themselves.
_SMALL_SELF = re.compile(
    rf"(?<!\w)(?i:my name is|me llamo|mi nombre es|je m'appelle|mon nom est|mi chiamo|il mio nome è|ich heiße|mein name ist|meu nome é|chamo-me|me chamo)[ ]+(?P<first>{_SMALL}+(?:['’-]{_SMALL}+)*)(?:[ ]+(?P<last>{_SMALL}+(?:['’-]{_SMALL}+)*))?(?![\w@(]|\.\w|/|-\w)"
)
#: Small words that follow a first name and are no last name.
_NO_LAST = frozenset("and i but from or so here with at in on by y e et und ma mais mas pero aber aus de da di del soy sono je ich eu".split())
#: No phone number or number of an identity paper is without these runs of digits.
_PHONE_SIGN = re.compile(r"\d(?:[ .\-/()]{0,3}\d){7}")
_ID_SIGN = re.compile(r"\d\d ?\d\d ?\d\d|\d{3}(?:-\d\d-|\.\d{3}\.)|\d\d[A-Z]\d\d[A-Z]\d{3}")

#: Common first names, in their usual spellings, of the languages read here.
_FIRST_NAMES = frozenset(
    "James John Robert Michael David Richard Joseph Thomas Christopher Daniel Matthew Anthony Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jeffrey Ryan Jacob Nicholas Jonathan Stephen Samuel "
    "Benjamin Gregory Alexander Patrick Oliver Harry Victor Marcus Simon Martin Peter Paul Adam Liam Noah Ethan Lucas Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret "
    "Sandra Ashley Emily Michelle Amanda Melissa Deborah Stephanie Rebecca Laura Helen Anna Emma Olivia Sophia Charlotte Hannah Rachel Julia Alice Claire Maria Elena Ingrid Leila Priya "
    "Hans Klaus Jürgen Stefan Wolfgang Andreas Jonas Lukas Felix Sebastian Tobias Katrin Sabine Monika Ursula Heike Anja Birgit Jean Pierre Michel Philippe Julien Mathieu Nicolas Antoine Camille Élodie "
    "Isabelle Nathalie Sophie Chloé Aurélie José Juan Carlos Javier Luis Miguel Alejandro Pablo Rafael Carmen Lucía Isabel Pilar Beatriz Sofía João Pedro Tiago Paulo Ana Fernanda Giovanni Giuseppe Marco "
    "Luca Matteo Francesco Chiara Giulia Francesca Paola Ivan Dmitri Sergei Olga Natalia Tatiana Wei Ming Hiroshi Takashi Yuki Sakura Ahmed Mohammed Fatima Aisha Omar Raj Arjun Anil Sunita Deepa".split()
)
_SELF = re.compile(
    r"(?:[Mm]y name is|[Tt]his is|[Mm]e llamo|[Mm]i nombre es|[Jj]e m'appelle|[Mm]on nom est|[Mm]i chiamo|[Ii]l mio nome è|[Ii]ch heiße|[Mm]ein Name ist|[Mm]eu nome é|[Cc]hamo-me|[Mm]e chamo|Меня зовут|"
    r"(?:Author|Committer|Maintainer|Reporter|Contact|Name|From|To|Cc|[A-Z][a-z]+(?:-[a-z]+)*-by)[:：]|(?:[Ss]igned|[Rr]eported|[Oo]pened|[Ww]ritten|[Rr]eviewed) (?:as|by)|"
    r"(?:[Rr]egards|[Ss]incerely|[Cc]heers|[Bb]est|[Ss]aludos|[Cc]ordialement|[Gg]rüße|[Aa]tenciosamente|[Ss]aluti),)\s+$"
)
#: A mailbox or a row of a table: a name before the address or number that goes with it.
_MAILBOX = re.compile(r"\s*<[^<>\s@]+(?:@|\(at\)|\[at\]|\s?\[at\]\s)|[;,\t][^;,\s@]+@[\w-]+\.|[;,\t]\(?\+?\d[\d ().-]{6,}")
_GREETED = re.compile(
    r"\b(?:hi|hello|dear|hey|hola|bonjour|salut|ciao|hallo|liebe[r]?|ol[aá]|oi|привет|ask|thanks|thank you|cc|mr\.?|mrs\.?|ms\.?|dr\.?|frau|herr|señora?|madame|monsieur|frag|fragt|demande(?:z)? à|chiedi a|pregunta a|pergunt[ae] a|fale com|"
    r"gracias|merci|danke|obrigad[oa]|grazie|спроси|пиши)[:,]?\s+$",
    re.I,
)
_BEFORE_NAME = re.compile(r"\b(?:to|user|from|by|for|and|with|e|y|et|und)[:,]?\s+$|[;\"]$", re.I)
_AFTER_NAME = re.compile(r"^(?:\s*[<;(]|,?\s+(?:and (?=[A-Z])|wrote|said|asked|says)|,\s)")
#: Capitalised words that begin sentences or address no one.
_NO_NAME = frozenset(
    "Ask Thanks Thank Regards Cheers The This That These Those There Here When Where What Why How Which Who If In On At For From To And But Or Not Is Are Was Were Do Does Did Can Could Should Would Will May Please Note Use Using See It We You They He She I My Our Your "
    "All Any Each Every Some No Yes Only Then Also After Before Since Until While With Without Best Hello Hi Dear Hey World Team Everyone Folks Der Die Das Ein Eine Ich Wir Sie Es Im Am Wenn Wie Was Warum Als Bitte Mein Meine Kein "
    "El La Los Las Un Una Le Les Des Il Lo Gli Mi Me Mon Ma Je Tu Que Si Para Por Se Os As O A Um Uma Meu Minha Como No Na Em De Da Do Di Del Della Al Con Per Non Qui Quando Cosa".split()
)
_PRODUCT = re.compile(
    r"^\s+(?:scheduler|queue|server|service|cluster|library|framework|engine|protocol|algorithm|module|plugin|driver|format|parser|database|release|build|theme|font|Street|Road|Lane|Ave|Close|"
    r"annotation|method|filter|theorem|distance|index|test|code|hash|tree|sort|notation|cipher|map|chart)\b",
    re.I,
)
_CALL = re.compile(
    r"(?:phone|tel(?:e(?:phone|fon[eo]?))?\.?|mobile|cell|(?:call|ring|dial|text)(?: (?:me|us|him|her|them))?(?: on| at)?|reach (?:me|us|him|her|them) (?:on|at)|number|fax|whatsapp|ll[áa]mame al|tel[ée]fono|appelez-moi au|au|ligue para|telefone|chiamami al|ruf mich unter|unter|Telefon|звони(?:те)?|电话|電話)"
    r"[:.\s]*(?:is|es|est|ist|è|é)?[:\s]*$",
    re.I,
)
_CALL_AFTER = re.compile(r"\s*,?\s*(?:as|is) (?:his|her|my|their|our) (?:\w+ )?(?:number|phone)|\s*\((?:phone|mobile|cell|tel|fax|home|work)\b", re.I)
_NOT_PHONE = re.compile(
    r"(?:build|ticket(?: number)?|constant|session(?: id)?|version|port|id|issue|order|invoice|commit|line|row|bytes|ip|calls|upgraded from|to|limit|code|pid|offset|timeout|revision|release|seed|mask|step|page|size|#|v|=|:\/\/\S*)\s*$",
    re.I,
)
_MACHINE = frozenset("git user users admin root ci deploy host svc noreply no-reply postgres mysql ubuntu ec2-user www-data daemon nobody me you your.name username name someone sip ssh".split())
_DATE = re.compile(r"^(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{1,3}(?:\.\d{1,3}){2,3}|\d{1,2}:\d{2})(?:[ T]\d{1,2})?$")


#: A form is looked for only where one of its signs is in the text; the signs are parts of what the pattern needs.
_ID_SIGNS = (
    "ssn", "security", "passport", "insurance", "licen", "tax", "identi", "id card", "nif", "cpf", "cnpj", "niss", "dni", "steuer", "ausweis", "sozialvers", "reisepass", "fiscal", "sécurité", "securite",
    "pasaporte", "passeport", "passaporte", "passaporto", "segurança", "contribuinte", "инн", "снилс", "паспорт", "身份证", "护照", "マイナンバー", "旅券",
)
_ADDRESS_SIGN = {
    "en": re.compile(r"\d[A-Za-z]? [A-ZÀ-Þ]"),
    "romance": re.compile(r"[ACELPRSTV](?:alle|/|v|aseo|la|amino|arretera|rav|onda|ia|orso|icolo|argo|trada|ua|raça|strada|lameda|iale|iazza)[^\n]{2,300}?\d"),
    "french": re.compile(r"\d(?: bis| ter| quater)?,? [rabcpiqs]"),
    "german": re.compile(r"[a-zßäöü] \d{1,4}[a-z]?(?![\w.])"),
    "cjk": re.compile("[路街道巷目地号]"),
    "russian": re.compile("(?:ул|пр|пер|ш|наб)[а-я.]"),
}
_ANY_DIGIT = re.compile(r"\d")
_EMAIL_SIGNS = ("@", "[at]", "(at)", "{at}", " dot ")


class Span(NamedTuple):
    """A possible item: its place, its type, and the votes of the type's labelers (1, -1 or 0 for none)."""

    start: int
    end: int
    kind: str
    votes: tuple[int, ...]


class Gazetteer(NamedTuple):
    """First and last names that introduced themselves, and common first names."""

    first: frozenset[str]
    last: frozenset[str]


#: What may stand between a name and the item that goes with it: marks and up to three words, no end of a sentence.
_NEAR_ITEM = re.compile(r"[ \t]*[<(\[\"';,|:\t-]*[ \t]*\n?[ \t]*(?:[a-zà-ÿ]+[:,]?[ \t]*){0,3}[<(\[\"';,|:\t-]*[ \t]*")
_FULL_NAME = re.compile(rf"{_CAP}[ ]{_CAP}")


def introduced(text: str) -> Iterator[tuple[str, str]]:
    """First and last name of each introduction in a text: contexts that only a person's name fills."""
    for m in _FULL_NAME.finditer(text):
        a, _, b = m[0].partition(" ")
        if a not in _NO_NAME and b not in _NO_NAME and (_SELF.search(text[max(0, m.start() - 24) : m.start()]) or _MAILBOX.match(text, m.end())):
            yield a, b


def learn_names(texts: list[str]) -> Gazetteer:
    """First names met at least twice and last names met in the introductions of texts."""
    pairs = [p for t in texts for p in introduced(t)]
    first = Counter(a for a, _ in pairs)
    return Gazetteer(_FIRST_NAMES | {w for w, n in first.items() if n >= 2}, frozenset(b for _, b in pairs))


def all_names(rows: DataFrame) -> DataFrame:
    """(word, first, last): names that introduce themselves in all messages, as ``learn_names`` keeps them.

    Introductions are counted per batch before anything is shuffled; texts without two capitalised words in a row are not read in Python.
    """
    told = rows.where(F.col("content").rlike(_FULL_NAME.pattern)).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = Counter(p for t in b.column(0).to_pylist() for p in introduced(t))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in n], pa.string()), pa.array([p[1] for p in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["a", "b", "n"])

    pairs = told.mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    words = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n").alias("f"), F.lit(0).cast("long").alias("l")), F.struct(F.col("b").alias("word"), F.lit(0).cast("long").alias("f"), F.col("n").alias("l")))).alias("x")).select("x.*")
    names = words.groupBy("word").agg(F.sum("f").alias("f"), F.sum("l").alias("l")).select("word", (F.col("f") >= 2).alias("first"), (F.col("l") >= 1).alias("last"))
    return names.where("first OR last")


def _gazetteer(rows) -> Gazetteer:
    return Gazetteer(_FIRST_NAMES | {r["word"] for r in rows if r["first"]}, frozenset(r["word"] for r in rows if r["last"]))


def _words(text: str | None) -> list[str]:
    """The words of a text that may be looked up as names."""
    told = {w.capitalize() for m in _SMALL_SELF.finditer(text or "") for w in m.groups() if w}
    return sorted(told.union(w.capitalize() for p in (_NAME, _SMALL_NAME) for m in p.finditer(text or "") for w in m[0].split()))


def with_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` (row_id, msg_pos, content) with the first and last names among their words, by a join of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [_words(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.list_(pa.string()))], names=["row_id", "msg_pos", "content", "words"])

    got = rows.mapInArrow(run, "row_id long, msg_pos int, content string, words array<string>").groupBy("row_id", "msg_pos", "content").agg(F.count("*").alias("copies"), F.first("words").alias("words"))
    met = got.select("row_id", "msg_pos", "content", "copies", F.explode_outer("words").alias("word")).join(names, "word", "left")
    kept = met.groupBy("row_id", "msg_pos", "content", "copies").agg(F.collect_set(F.when(F.col("first"), F.col("word"))).alias("first"), F.collect_set(F.when(F.col("last"), F.col("word"))).alias("last"))
    return kept.select("row_id", "msg_pos", "content", "first", "last", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def _vote(*pairs: tuple[bool, int]) -> tuple[int, ...]:
    return tuple(v if hit else 0 for hit, v in pairs)


def spans(text: str, names: Gazetteer) -> list[Span]:
    """All candidates of all types with their labelers' votes; an address, e-mail or number hides what is inside."""
    out: list[Span] = []
    taken: list[tuple[int, int]] = []
    told: list[tuple[int, int]] = []  # what a name may stand beside: items with the words that name them

    def beside(a: int, b: int) -> bool:
        return any(_NEAR_ITEM.fullmatch(text[b:x] if x >= b else text[y:a]) for x, y in told if 0 <= x - b <= 24 or 0 <= a - y <= 24)

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    low = text.lower()
    digits_in = _ANY_DIGIT.search(text) is not None
    for m in _EMAIL.finditer(text) if any(x in low for x in _EMAIL_SIGNS) else ():
        local = re.split(r"\s?(?:@|\[at\]|\(at\)|\{at\}| at )", m[0], flags=re.I)[0]
        domain = m[0][len(local) :]
        dotted = bool(re.search(r"\.|dot", domain[1:], re.I))
        end = m.end() - (len(m[0]) - len(m[0].rstrip(".-")))
        before, after = text[max(0, m.start() - 12) : m.start()], text[end : end + 2]
        out.append(Span(m.start(), end, "email", _vote(
            (dotted, 1),
            (not dotted, -1),
            (local.lower() in _MACHINE or local.lower().startswith(("svc_", "svc-")), -1),
            (bool(re.match(r":[\w~/]", after)), -1),
            (bool(re.search(r"://[^\s/]*$", before)) or "ssh-" in text[max(0, m.start() - 90) : m.start()].rpartition("\n")[2], -1),
            (bool(re.search(r"\.(?:invalid|local|localhost|internal|lan)\b", domain)), -1),
        )))
        if not any(v < 0 for v in out[-1].votes):
            taken.append((m.start(), end))
            told.append((m.start(), end))
    for form, pattern in _ADDRESSES.items():
        if not (digits_in or form == "cjk") or not _ADDRESS_SIGN[form].search(text):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if not free(a, b):
                continue
            out.append(Span(a, b, "address", _vote(
                (bool(re.search(r"\d", m[0])) or form == "cjk", 1),
                (bool(re.search(r"\b\d{5}\b|\b[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b", m[0])), 1),
                (bool(re.search(r",[ \n]|\n", m[0])), 1),
                (bool(re.search(rf"{_UNIT}", m[0])), 1),
                (not re.search(r"[,\n]", m[0]) and not re.search(r"\d{5}", m[0]), -1),
                (bool(_NOT_PHONE.search(text[max(0, a - 20) : a])), -1),
            )))
            taken.append((a, b))
            told.append((a, b))
    for m in _ID_NAMED.finditer(text) if digits_in and (any(x in low for x in _ID_SIGNS) or "NIE" in text or "RG" in text) else ():
        a, b = m.span("value")
        value = m["value"]
        # words that follow the number in lower or mixed case are not part of it
        cut = re.search(r"[ ](?=[A-Za-z]*[a-z])", value)
        if cut:
            value, b = value[: cut.start()], a + cut.start()
        if sum(ch.isdigit() for ch in value) < 5 or not free(a, b):
            continue
        out.append(Span(a, b, "id_number", _vote((True, 1), (bool(_ID_SHAPE.fullmatch(value)), 1), (len(value) > 26, -1), (False, -1))))
        taken.append((a, b))
        told.append((m.start(), b))
    for m in _ID_SHAPE.finditer(text) if digits_in and _ID_SIGN.search(text) else ():
        if free(*m.span()):
            line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
            out.append(Span(*m.span(), "id_number", _vote((False, 1), (True, 1), (False, -1), (bool(_NOT_PHONE.search(line)), -1))))
            taken.append(m.span())
    for m in _PHONE.finditer(text) if digits_in and _PHONE_SIGN.search(text) else ():
        a, b = m.span()
        s = m[0]
        digits = re.sub(r"\D", "", s)
        if not 8 <= len(digits) <= 15 or not free(a, b):
            continue
        before = text[max(0, a - 40) : a].rpartition("\n")[2]
        named = bool(_CALL.search(before) or _CALL_AFTER.match(text, b))
        row = re.search(r"[;,\t]\"?$", before) is not None and bool(re.search(r"[;\"\n]|$", text[b : b + 1]))
        out.append(Span(a, b, "phone", _vote(
            (bool(re.match(r"\+|00[1-9]", s)), 1),
            (named, 1),
            (bool(re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|0\d{4} \d{3} ?\d{3}|\d{3} \d{3} ?\d{3}|0\d(?: \d{2}){4}", s)), 1),
            (row, 1),
            (bool(_NOT_PHONE.search(before)) and not re.match(r"\+", s), -1),
            (bool(_DATE.match(s)), -1),
            (s.isdigit() and not named and not row, -1),
            (bool(re.search(r"[=<>({]\s*$|[a-f0-9]-$", before)), -1),
        )))
        if _sure(out[-1]) is not False:
            said = _CALL.search(before)
            told.append((a - len(said[0]) if said else a, b))
    for m in chain(_NAME.finditer(text), _SMALL_NAME.finditer(text) if "hi " in low else ()):
        # a word alone is no candidate unless it is known or greeted
        if not any(x in m[0] for x in " \t") and m[0].capitalize() not in names.first and text[m.end() : m.end() + 1] not in (",", "!", ".", "\n", "\r"):
            continue
        for a, b in _name_parts(text, m.start(), m.end(), names):
            if not free(a, b):
                continue
            words = text[a:b].split()
            known = words[0].capitalize() in names.first
            pair = len(words) >= 2
            surname = pair and words[-1].capitalize() in names.last
            before, after = text[max(0, a - 24) : a], text[b : b + 24]
            said, greeted, with_item = bool(_SELF.search(before)), bool(_GREETED.search(before)), beside(a, b)
            near = greeted or bool(_BEFORE_NAME.search(before) or _AFTER_NAME.match(after))
            if pair and text[a:b].isupper() and not (known or surname or said or with_item):
                continue
            if not pair and not known and not (greeted and after[:1] in (",", "!", ".", "\n", "\r")):
                continue
            out.append(Span(a, b, "name", _vote(
                (known, 1),
                (surname or (known and pair), 1),
                (said, 1),
                (near and (known or greeted), 1),
                (with_item, 1),
                (bool(_PRODUCT.match(after)), -1),
                (not pair and not near and not said and not with_item, -1),
                (not (known or said or greeted or with_item or surname), -1),
                (bool(re.match(r"[\w]*[(_=.]\w|\s*=", after)) or text[a - 1 : a] in ("_", ".", "/", "$", "#"), -1),
            )))
    for m in _SMALL_SELF.finditer(text):
        known, surname = m["first"].capitalize() in names.first, (m["last"] or "").capitalize() in names.last
        a, b = m.start("first"), m.end("last" if surname or (m["last"] and m["last"] not in _NO_LAST) else "first")
        if known and free(a, b):
            out.append(Span(a, b, "name", _vote((True, 1), (surname, 1), (True, 1), (False, 1), (beside(a, b), 1), (bool(_PRODUCT.match(text[b : b + 24])), -1), (False, -1), (False, -1), (False, -1))))
    return out


def _name_parts(text: str, a: int, b: int, names: Gazetteer) -> Iterator[tuple[int, int]]:
    """Of a run of capitalised words, the parts that may be a person's name: a known first name with the word after it,
    any two words of which none begins sentences, a word alone."""
    words = [(a + w.start(), a + w.end()) for w in re.finditer(r"\S+", text[a:b])]
    i = 0
    while i < len(words):
        word = text[words[i][0] : words[i][1]]
        known_next = word.capitalize() not in names.first and i + 1 < len(words) and text[words[i + 1][0] : words[i + 1][1]].capitalize() in names.first
        if word.capitalize() in _NO_NAME or known_next:
            i += 1
            continue
        follows = i + 1 < len(words) and text[words[i + 1][0]].isupper() and text[words[i + 1][0] : words[i + 1][1]] not in _NO_NAME
        yield words[i][0], words[i + 1 if follows else i][1]
        i += 2 if follows else 1


class Model(NamedTuple):
    names: Gazetteer
    weights: dict[str, list[float]]


#: How strongly weights are drawn to those before training.
RIDGE = 5.0
#: Weights before training: labelers count alike, the rest must outweigh a doubt.
_PRIOR = {"email": 6, "phone": 8, "id_number": 4, "address": 6, "name": 9}


def _row(s: Span) -> list[float]:
    plus, minus = sum(v > 0 for v in s.votes), sum(v < 0 for v in s.votes)
    return [1.0, *map(float, s.votes), float(plus), float(minus), float(plus > minus)]


def em(votes: np.ndarray, rounds: int = 30, counts: np.ndarray | None = None) -> np.ndarray:
    """Probability that each candidate is an item, by expectation-maximisation over the labelers' reliabilities.

    A labeler has a rate of voting on items and on others; both are smoothed and start from the majority vote.
    With ``counts`` each row of ``votes`` stands for so many candidates.
    """
    n = np.ones(len(votes)) if counts is None else counts
    p = np.clip(0.5 + 0.3 * votes.sum(1), 0.02, 0.98)
    said = votes != 0
    sign = np.sign((n[:, None] * votes).sum(0) + 1e-9)
    for _ in range(rounds):
        items, others = n * p, n * (1 - p)
        prior = np.clip(items.sum() / n.sum(), 0.02, 0.98)
        on = ((items[:, None] * said).sum(0) + 0.5) / (items.sum() + 1)
        off = ((others[:, None] * said).sum(0) + 0.5) / (others.sum() + 1)
        # a labeler keeps its direction: it may be unreliable, but doesn't turn round
        on, off = np.where(sign > 0, np.maximum(on, off), np.minimum(on, off)), np.where(sign > 0, np.minimum(on, off), np.maximum(on, off))
        log_odds = np.log(prior / (1 - prior)) + np.where(said, np.log(on / off), np.log((1 - on) / (1 - off))).sum(1)
        p = np.clip(1 / (1 + np.exp(-np.clip(log_odds, -30, 30))), 0.001, 0.999)
    return p


def _fit(x: np.ndarray, p: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights of the logistic regression of ``p`` on ``x``, drawn to ``start``: Newton steps, each halved until the loss falls, else they may run away."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(n @ (np.logaddexp(0, z) - p * z)) + RIDGE / 2 * float((w - start) @ (w - start))

    w, here = start.copy(), loss(start)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (q - p)) + RIDGE * (w - start)
        h = (x * (n * q * (1 - q))[:, None]).T @ x + RIDGE * np.eye(x.shape[1])
        step, length = np.linalg.solve(h, g), 1.0
        while (there := loss(w - length * step)) > here and length > 1e-6:
            length /= 2
        if there >= here:
            break
        w, here = w - length * step, there
    return w


def weigh(patterns: dict[tuple[str, tuple[int, ...]], int]) -> dict[str, list[float]]:
    """Labeler reliabilities and one logistic span classifier per type, from how many candidates have each pattern of votes."""
    weights = {}
    for kind in TYPES:
        start = np.array([-0.5, *[1.5] * _PRIOR[kind], 0.0, 0.0, 1.0])
        got = sorted((votes, n) for (k, votes), n in patterns.items() if k == kind)
        total = sum(n for _, n in got)
        if total >= 20:
            votes, n = np.array([v for v, _ in got], float), np.array([n for _, n in got], float)
            x = np.array([_row(Span(0, 0, kind, v)) for v, _ in got])
            start = _fit(x, em(votes, counts=n), n * min(1.0, MOST_WEIGHT / total), start)
        weights[kind] = start.tolist()
    return weights


def train(texts: list[str], names: Gazetteer | None = None) -> Model:
    """The model of unlabelled texts; the gazetteer as given, else from them."""
    names = names or learn_names(texts)
    return Model(names, weigh(Counter((s.kind, s.votes) for t in texts for s in spans(t, names))))


def _sure(s: Span) -> bool | None:
    """The exact check after the score: a veto that holds whatever the weights, else None."""
    if s.kind == "email":
        return s.votes[0] > 0 and not any(v < 0 for v in s.votes)
    if s.kind == "phone" and (s.votes[5] < 0 or not any(v > 0 for v in s.votes) or (s.votes[4] < 0 and not s.votes[1])):
        return False
    if s.kind == "name" and (s.votes[5] < 0 or s.votes[8] < 0):
        return False
    return None


def found(text: str | None, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, type) of the items of a text, in order and apart; none for null and blank texts."""
    return kept(spans(text, model.names), model.weights) if text and text.strip() else []


def kept(candidates: list[Span], weights: dict[str, list[float]]) -> list[tuple[int, int, str]]:
    """(start, end, type) of the items among the candidates of a text."""
    hits = []
    for s in candidates:
        sure = _sure(s)
        z = sum(w * f for w, f in zip(weights[s.kind], _row(s), strict=True))
        if sure is not False and 1 / (1 + exp(-max(-30.0, min(30.0, z)))) >= 0.5:
            hits.append((s.start, s.end, s.kind))
    out, upto = [], -1
    for a, b, kind in sorted(set(hits), key=lambda h: (h[0], -h[1])):
        if a >= upto:
            out.append((a, b, kind))
            upto = b
    return out


def replace(text: str | None, model: Model) -> str | None:
    """The text with each item replaced by its type in brackets, such as [EMAIL]; null stays null."""
    if text is None:
        return None
    parts, at = [], 0
    for a, b, kind in found(text, model):
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(parts) + text[at:]


_ITEM = pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("pii_type", pa.string())])
_SPAN = pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("kind", pa.string()), ("votes", pa.list_(pa.int8()))])


def _named(raw: DataFrame) -> tuple[DataFrame, Gazetteer | None]:
    """The messages (row_id, msg_pos, content, first, last), and the names of all; None where each message has its own in first and last."""
    spark = raw.sparkSession
    rows = messages(raw, "row_id").select(F.col("row_id").cast("long").alias("row_id"), "msg_pos", "content")
    checkpoint_dir(spark)
    names = all_names(rows).checkpoint()
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("chars")).first()
    if size["n"] > MOST_NAMES or size["chars"] > MOST_NAME_CHARS:
        return with_names(rows, names), None
    empty = F.array().cast("array<string>")
    return spread(rows).select("*", empty.alias("first"), empty.alias("last")), _gazetteer(names.collect())


def _gazetteers(b: pa.RecordBatch, known: Gazetteer | None) -> list[Gazetteer]:
    """The names to look up in each message of a batch of ``_named``."""
    if known is not None:
        return [known] * b.num_rows
    return [Gazetteer(_FIRST_NAMES.union(f), frozenset(n)) for f, n in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]


def _candidates(rows: DataFrame, known) -> DataFrame:
    """(row_id, msg_pos, spans array<struct<start_pos,end_pos,kind,votes>>) of the messages with candidates, checkpointed: places and votes, no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [spans(t, g) if t and t.strip() else [] for t, g in zip(b.column(2).to_pylist(), _gazetteers(b, known.value), strict=True)]
            at = pa.array([i for i, x in enumerate(got) if x], pa.int64())
            told = pa.array([[(x.start, x.end, x.kind, x.votes) for x in found] for found in got if found], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), told], names=["row_id", "msg_pos", "spans"])

    return rows.mapInArrow(run, "row_id long, msg_pos int, spans array<struct<start_pos:int,end_pos:int,kind:string,votes:array<tinyint>>>").checkpoint()


def _weights(candidates: DataFrame) -> dict[str, list[float]]:
    """The weights from the votes on all candidates: their patterns are counted, of which a type has at most two to the power of its labelers."""
    rows = candidates.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").count().collect()
    return weigh({(r["kind"], tuple(r["votes"])): r["count"] for r in rows})


def scan(raw: DataFrame) -> DataFrame:
    """(row_id, msg_pos, items array<struct<start_pos,end_pos,pii_type>>, replaced) of every message.

    Names are learnt from the introductions of all messages, weights from the votes on the candidates of all; then a last
    pass goes over each whole message where it lies, without a shuffle unless there are more than MOST_NAMES names.
    Null contents have no items and stay null; an empty table gives no rows; other columns are not read.
    """
    sc = raw.sparkSession.sparkContext
    rows, names = _named(raw)
    known = sc.broadcast(names)
    weights = sc.broadcast(_weights(_candidates(rows, known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            hits = [[{"start_pos": x, "end_pos": y, "pii_type": k} for x, y, k in found(t, Model(g, weights.value))] for t, g in zip(texts, _gazetteers(b, known.value), strict=True)]
            clean = []
            for t, h in zip(texts, hits, strict=True):
                for x in reversed(h):
                    t = t[: x["start_pos"]] + f"[{x['pii_type'].upper()}]" + t[x["end_pos"] :]
                clean.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, pa.list_(_ITEM)), pa.array(clean, pa.string())], names=["row_id", "msg_pos", "items", "replaced"])

    return rows.mapInArrow(run, "row_id long, msg_pos int, items array<struct<start_pos:int,end_pos:int,pii_type:string>>, replaced string")


def found_rows(raw: DataFrame) -> DataFrame:
    """(row_id, msg_pos, start_pos, pii_type): one row per item; repeated rows come out once. Texts are searched for candidates once."""
    sc = raw.sparkSession.sparkContext
    rows, names = _named(raw)
    candidates = _candidates(rows, sc.broadcast(names))
    weights = sc.broadcast(_weights(candidates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [kept([Span(s["start_pos"], s["end_pos"], s["kind"], tuple(s["votes"])) for s in spans], weights.value) for spans in b.column(2).to_pylist()]
            at = pa.array([i for i, x in enumerate(got) for _ in x], pa.int64())
            starts, kinds = pa.array([a for x in got for a, _, _ in x], pa.int32()), pa.array([k for x in got for _, _, k in x], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), starts, kinds], names=["row_id", "msg_pos", "start_pos", "pii_type"])

    return candidates.mapInArrow(run, "row_id long, msg_pos int, start_pos int, pii_type string").distinct()


def replaced_rows(raw: DataFrame) -> DataFrame:
    """(row_id, msg_pos, replaced) of every message."""
    return scan(raw).select("row_id", "msg_pos", "replaced")
