"""Problem 6: prompt and response pairs with a defective response."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pytext import py_strip
from ..operators.messages import flat, messages
from ..session import checkpoint_dir, spread
from . import language, prose, truncation

DEFECTS = ("empty", "refusal", "copy", "truncated", "wrong_language")
#: Bound of the words kept per language.
STOPWORDS = 400
#: A sentence goes with declining ones where it is met so often beside them, and in so large a share of its texts.
BESIDE_TEXTS, BESIDE_SHARE = 2, 0.8
#: A response copies where at least so much of it, and of the prompt, lies in common runs of RUN tokens or more.
COPIED, OF_PROMPT, RUN = 0.8, 0.6, 3

_NOTHING = re.compile(r"^[\W_]*(?:n/?a|null|none|nil|nan|undefined|empty|no answer|no response|todo|tbd)?[\W_]*$", re.I)

#: Phrases that decline, and phrases that go with declining, in lower case.
_DECLINE = """
can't help|cannot help|can not help|unable to help|not able to help|can't assist|cannot assist|unable to assist|not able to assist|no assistance is possible|must decline|have to decline|need to decline
i decline|won't be able to|will not be able to|rather not answer|prefer not to answer|rather not|not allowed to|i am allowed to do|against the guidelines|against my guidelines|against our guidelines
i will not continue|as a language model|as an ai|no way to do this for you|talk about something else|not the right one for it|ask a specialist|refuse to answer|i refuse|not something i can|can't provide|cannot provide
can't answer|cannot answer|not comfortable|can't comply|cannot comply|can't fulfill|cannot fulfill|can't do that for you|must refuse
no puedo ayudar|no puedo responder|no me es posible|prefiero no responder|debo rechazar|tengo que rechazar|no me está permitido|no se me permite|como modelo de lenguaje|no puedo proporcionar|no estoy autorizad
ne peux pas vous aider|ne peux pas t'aider|ne peux pas répondre|il m'est impossible|je dois refuser|refuser de répondre|préfère ne pas répondre|ne m'est pas permis|en tant que modèle de langue|pas autorisé à|ne suis pas en mesure
nicht helfen|nicht weiterhelfen|nicht beantworten|als sprachmodell|leider ablehnen|muss ich ablehnen|ablehnen, |lieber nicht|nicht gestattet|nicht erlaubt, |nicht möglich, das zu tun|nicht antworten
não posso ajudar|não posso responder|não me é possível|não me é permitido|prefiro não responder|devo recusar|tenho que recusar|preciso recusar|como modelo de linguagem|não consigo ajudar
non posso aiutar|non posso rispondere|non mi è possibile|non mi è permesso|non mi è consentito|preferisco non rispondere|devo rifiutare|come modello linguistico|come modello di linguaggio
не могу помочь|не могу ответить|не могу выполнить|вынужден отказаться|вынуждена отказаться|отказаться отвечать|предпочитаю не отвечать|мне не разрешено|мне нельзя|как языковая модель|не имею возможности|предпочту не отвечать|не буду отвечать
无法帮助|不能帮助|无法协助|不能回答|无法回答|无法完成|拒绝回答|不便回答|作为一个语言模型|作为语言模型|作为一个ai|我不被允许|无法提供|不允许我|不想回答
お手伝いできません|お手伝いすることはできません|お答えできません|答えることはできません|お答えすることはできません|言語モデルとして|お断り|対応できません|回答できません|回答を控え|お応えできません|許可されていません|答えられません|差し控え
""".replace("\n", "|").strip("|").split("|")
_BESIDE = """
my apologies|i'm sorry|i am sorry|sorry,|so sorry|apologize|anything else you would like|need something else|something else instead|feel free to ask|any other question|consult a qualified|qualified professional
other resources|may be frustrating|hope you understand|thank you for understanding|thanks for understanding|could be misused|regrettably|unfortunately|let me know if|happy to help with something else
lo siento|lamento|disculpa|perdona|désolé|je regrette|tut mir leid|entschuldig|bedaure|desculpe|lamento|sinto muito|mi dispiace|mi spiace|scusa|purtroppo|извините|простите|сожалению|抱歉|对不起|遗憾|申し訳|すみません|残念ながら|ごめん
se podría usar mal|podría usarse mal|autre question|otra pregunta|andere frage|outra pergunta|altra domanda|другой вопрос|其他问题|ほかの質問|他の質問|専門家|专业人士|специалист|spécialiste|especialista|fachmann|fachperson|profesional|professionista|profissional
""".replace("\n", "|").strip("|").split("|")
_ENDS = re.compile(r"(?<=[.!?])[\"')\]*_]*\s+|(?<=[。！？])|\n+")


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in _BESIDE:
        a.add_word(phrase, 1)
    for phrase in _DECLINE:
        a.add_word(phrase, 2)
    a.make_automaton()
    return a


class SuffixAutomaton:
    """The suffix automaton of a sequence of tokens: it reads exactly the runs of tokens that occur in it."""

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for token in tokens:
            here = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and token not in self.next[p]:
                self.next[p][token] = here
                p = self.link[p]
            if p < 0:
                self.link[here] = 0
            else:
                q = self.next[p][token]
                if self.length[q] == self.length[p] + 1:
                    self.link[here] = q
                else:
                    twin = self._state(self.length[p] + 1, dict(self.next[q]))
                    self.link[twin] = self.link[q]
                    self.link[q] = self.link[here] = twin
                    while p >= 0 and self.next[p].get(token) == q:
                        self.next[p][token] = twin
                        p = self.link[p]
            last = here

    def _state(self, length: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def covered(self, tokens: list[str], least: int) -> int:
        """How many tokens lie in runs of at least ``least`` tokens that occur in the automaton's sequence."""
        state = run = total = upto = 0
        for i, token in enumerate(tokens):
            while state and token not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                run += 1
            if run >= least:
                total += i + 1 - max(upto, i + 1 - run)
                upto = i + 1
        return total


_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|\w+")


def copies(prompt: str, answer: str) -> bool:
    """Whether the answer only repeats the prompt, by the share of both that lies in common runs.

    The automaton is built only where enough of the answer's tokens occur in the prompt at all.
    """
    b = _TOKEN.findall(answer.lower())
    if len(b) < RUN:
        return False
    a = _TOKEN.findall(prompt.lower())
    least = min(RUN, len(a))
    known = set(a)
    if not a or sum(t in known for t in b) < COPIED * len(b):
        return False
    return SuffixAutomaton(a).covered(b, least) >= COPIED * len(b) and SuffixAutomaton(b).covered(a, least) >= OF_PROMPT * len(a)


class Model(NamedTuple):
    """Stopwords with their languages, what follows the ends of sentences, and the sentences that go with declining ones."""

    words: dict[str, str]
    ends: dict
    beside: frozenset[str] = frozenset()


def _form(sentence: str) -> str:
    """A sentence by its words, digits alike, so that it can be met again."""
    return re.sub(r"\W+", " ", re.sub(r"\d+", "0", sentence)).strip()


def sentences(text: str) -> list[str]:
    return [s for s in _ENDS.split(text.strip().lower().replace("’", "'")) if re.search(r"\w", s)]


def told_by(text: str, phrases) -> tuple[bool, set[str]]:
    """Whether a text has a declining phrase, and the forms of its sentences."""
    own = sentences(text)
    return any(v == 2 for s in own for _, v in phrases.iter(s)), {_form(s) for s in own}


def learn_beside(texts: list[str]) -> frozenset[str]:
    """Sentences that stand beside declining ones: met twice or more in texts with a declining phrase, which label them weakly, and seldom elsewhere."""
    phrases, within, elsewhere = _automaton(), Counter(), Counter()
    for t in texts:
        declining, forms = told_by(t, phrases)
        (within if declining else elsewhere).update(forms)
    return frozenset(s for s, n in within.items() if n >= BESIDE_TEXTS and n >= BESIDE_SHARE * (n + elsewhere[s]))


def word_counts(labelled: Iterator[tuple[str, str]]) -> dict[str, Counter[str]]:
    """By language, in how many units of prose each word is."""
    by: dict[str, Counter[str]] = {}
    for text, code in labelled:
        n = by.setdefault(code, Counter())
        for u in language.units(text):
            n.update(set(words_of(u)))
    return by


def stopwords(by: dict[str, Counter[str]], total: dict[str, int], kinds: dict[str, int]) -> dict[str, str]:
    """Per language its most frequent words that no other language has more often. ``by`` has the counts of these words in all
    languages, ``total`` the sum of all counts of a language, ``kinds`` how many words it has."""
    words: dict[str, str] = {}
    lead: dict[str, float] = {}
    for c, n in sorted(by.items()):
        for w, k in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:STOPWORDS]:
            if k < 2 and kinds[c] > 50:
                continue
            rate, rest = k / total[c], max((m[w] / total[d] for d, m in by.items() if d != c and total[d]), default=0.0)
            if rate > 3 * rest and rate > lead.get(w, 0):
                words[w], lead[w] = c, rate
    return words


def train(labelled: list[tuple[str, str]]) -> Model:
    """Stopwords, the terminator model, and the sentences that go with declining ones, of labelled texts."""
    by = word_counts(labelled)
    texts = [t for t, _ in labelled]
    return Model(stopwords(by, {c: sum(n.values()) for c, n in by.items()}, {c: len(n) for c, n in by.items()}), truncation.fit(texts), learn_beside(texts))


def words_of(unit: str) -> list[str]:
    """Words of a unit; for scripts without spaces, pairs of characters."""
    out = []
    for w in unit.split():
        if language._CJK.search(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w)
    return out


_ASKED = {
    "de": "german|deutsch|alemán|alemão|allemand|tedesco|немецк|德语|德文|ドイツ語", "en": "english|englisch|inglés|inglês|anglais|inglese|английск|英语|英文|英語",
    "es": "spanish|spanisch|español|espanhol|espagnol|spagnolo|испанск|西班牙|スペイン語", "fr": "french|französisch|francés|francês|français|francese|французск|法语|法文|フランス語",
    "it": "italian|italienisch|italiano|italien|итальянск|意大利|イタリア語", "ja": "japanese|japanisch|japonés|japonês|japonais|giapponese|японск|日语|日文|日本語",
    "pt": "portuguese|portugiesisch|portugués|português|portugais|portoghese|португальск|葡萄牙|ポルトガル語", "ru": "russian|russisch|ruso|russo|russe|русск|俄语|俄文|ロシア語",
    "zh": "chinese|chinesisch|chino|chinês|chinois|cinese|китайск|中文|汉语|中国語",
}
_ASKED_FOR = {c: re.compile(p, re.I) for c, p in _ASKED.items()}


def votes(text: str, model: Model) -> Counter[str]:
    """Stopword votes of a text's prose by language."""
    n: Counter[str] = Counter()
    for u in language.units(text):
        for w in words_of(u):
            c = model.words.get(w)
            if c:
                n[c] += 1
    return n


def _at_most(text: str, model: Model) -> dict[str, int] | None:
    """For each language no fewer votes than ``votes`` gives, as all words count; None where that takes more than words."""
    if language._CJK.search(text):
        return None
    n: dict[str, int] = {}
    for c in map(model.words.get, language._LETTERS.findall(text.lower())):
        if c:
            n[c] = n.get(c, 0) + 1
    return n


def other_language(prompt: str, answer: str, model: Model) -> bool:
    """The answer is wholly in a language that the prompt neither uses nor names.

    Pairs where no two languages can have the votes for that are told from all their words, without a look for prose.
    """
    asked = _at_most(prompt, model)
    if (own := _at_most(answer, model)) is not None and not any(n >= 3 and (asked is None or any(t != c for t in asked)) for c, n in own.items()):
        return False
    a = votes(answer, model)
    if sum(a.values()) < 3:
        return False
    (lang, most), *_ = a.most_common(1)
    if most < 0.85 * sum(a.values()) or (asked is not None and not any(t != lang for t in asked)):
        return False
    p = votes(prompt, model)
    if not p or p[lang] >= max(2, 0.12 * sum(p.values())):
        return False
    top = p.most_common(1)[0]
    return top[0] != lang and p[lang] * 4 < top[1] and not _ASKED_FOR[lang].search(prompt)


def unsure(answer: str, phrases) -> list[str] | None:
    """The sentences, by their form, that must go with declining ones for the answer to decline: those without a phrase. None where it doesn't
    decline in any case, as a sentence tells more or none declines."""
    hit, asked = False, []
    for sentence in sentences(answer):
        best = max((v for _, v in phrases.iter(sentence)), default=0)
        if len(sentence) > 250 or re.search(r"[{}=<>]", sentence):
            return None
        if not best:
            asked.append(_form(sentence))
        hit = hit or best == 2
    return asked if hit else None


def declines(answer: str, phrases, beside: frozenset[str] = frozenset()) -> bool:
    """Every sentence of the answer declines or goes with declining, and one declines."""
    asked = unsure(answer, phrases)
    return asked is not None and beside.issuperset(asked)


_EDGES = "\u200b\ufeff \t\r\n\xa0\u3000"


class Told(NamedTuple):
    """What a pair tells by itself: a defect that is plain; the sentences (``asked``) that make it a refusal if all go with declining
    ones; whether the answer is in an ``other`` language; how it ends."""

    defect: str | None = None
    asked: tuple[str, ...] = ()
    other: bool = False
    end: truncation.Ending = truncation.Ending()


def told(prompt: str | None, answer: str | None, model: Model, phrases) -> Told:
    """What a pair tells by itself, with the stopwords of ``model``; pairs with a blank prompt tell nothing."""
    if prompt is None or not prompt.strip(_EDGES):
        return Told()
    text = (answer or "").strip(_EDGES)
    if not text or _NOTHING.match(text):
        return Told("empty")
    asked = unsure(text, phrases)
    if asked == []:
        return Told("refusal")
    asked = tuple(dict.fromkeys(asked or ()))
    if copies(prompt, text):
        return Told("copy", asked)
    return Told(None, asked, other_language(prompt, text, model), truncation.ending(text))


def verdict(t: Told, beside: bool, n) -> str | None:
    """The defect of a pair, given whether the sentences asked all go with declining ones, and what follows the end of its answer in all texts."""
    if t.asked and beside:
        return "refusal"
    if t.defect:
        return t.defect
    cut = truncation.verdict(t.end, False, n)
    if t.other:
        return "wrong_language" if cut is None else "truncated"
    return "truncated" if cut else None


def defect(prompt: str | None, answer: str | None, model: Model, phrases) -> str | None:
    """The defect of a pair, one of DEFECTS, or None; pairs with a blank prompt have none."""
    t = told(prompt, answer, model, phrases)
    return verdict(t, model.beside.issuperset(t.asked), truncation.seen(model.ends, t.end.tail) if t.end.tail else None)


def pairs(raw: DataFrame) -> DataFrame:
    """(row_id, msg_pos, prompt, answer): each user message with the assistant message right after it, null where there is none."""
    m = flat(F.col("conversation"))
    role = lambda x: F.lower(py_strip(x["role"]))
    both = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("m") - 1), lambda i: role(F.get("m", i)) == "user"),
        lambda i: F.struct(i.alias("msg_pos"), F.get("m", i)["content"].alias("prompt"), F.when(role(F.get("m", i + 1)) == "assistant", F.get("m", i + 1)["content"]).alias("answer")),
    )
    rows = raw.select(F.col("row_id").cast("long").alias("row_id"), m.alias("m")).where(F.size("m") >= 1)
    return rows.select("row_id", F.explode(both).alias("p")).select("row_id", F.col("p.msg_pos").cast("int").alias("msg_pos"), "p.prompt", "p.answer")


def labelled(raw: DataFrame) -> DataFrame:
    """(text, code): the messages whose label names a language."""
    rows = messages(raw, "row_id").select(F.col("content").alias("text"), py_strip(F.col("language")).alias("label"))
    return rows.select("text", language.label_language().alias("code")).where("text IS NOT NULL AND code IS NOT NULL")


def all_stopwords(rows: DataFrame) -> dict[str, str]:
    """The stopwords of all labelled messages (text, code). Words are counted per batch before they are shuffled; what is collected are the counts
    of at most STOPWORDS words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by = word_counts(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            got = [(c, w, k) for c, n in by.items() for w, k in n.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.int64())], names=["code", "word", "n"])

    counts = rows.mapInArrow(run, "code string, word string, n long").groupBy("code", "word").agg(F.sum("n").alias("n")).checkpoint()
    rank = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "word"))
    most = counts.select("word", rank.alias("rank")).where(F.col("rank") <= STOPWORDS).select("word").distinct()
    by: dict[str, Counter[str]] = {}
    for r in counts.join(F.broadcast(most), "word", "left_semi").collect():
        by.setdefault(r["code"], Counter())[r["word"]] = r["n"]
    sums = counts.groupBy("code").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).collect()
    return stopwords(by, {r["code"]: r["total"] for r in sums}, {r["code"]: r["kinds"] for r in sums})


def _key(form: str) -> int:
    return int.from_bytes(blake2b(form.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _beside(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(key) of the asked sentences (place, key) that go with declining ones, counted over all labelled messages.

    A table of 2 ** SLOT_BITS bits tells which sentences no answer asks for, before anything is shuffled.
    """
    bits = truncation.SLOT_BITS
    slots = np.zeros(1 << bits, bool)
    slots[np.asarray(asked.select(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("slot")).distinct().toArrow()["slot"])] = True
    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, phrases = np.unpackbits(sent.value).astype(bool), _automaton()
        for b in batches:
            met: tuple[Counter[int], Counter[int]] = (Counter(), Counter())
            for t in b.column(0).to_pylist():
                declining, forms = told_by(t, phrases)
                met[declining].update(k for k in map(_key, forms) if wanted[(k & (1 << 64) - 1) >> 64 - bits])
            keys = list(met[0].keys() | met[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array([n[k] for k in keys], pa.int64()) for n in met]], names=["key", "elsewhere", "within"])

    n = rows.select("text").mapInArrow(run, "key long, elsewhere long, within long").groupBy("key").agg(F.sum("within").alias("within"), F.sum("elsewhere").alias("elsewhere"))
    sure = n.where((F.col("within") >= BESIDE_TEXTS) & (F.col("within") >= BESIDE_SHARE * (F.col("within") + F.col("elsewhere"))))
    return sure.join(asked.select("key").distinct(), "key", "left_semi").select("key")


_STATE = "row_id long, msg_pos int, defect string, asked array<long>, other boolean, kind string, ask string, loose boolean, gap boolean, tail long, " + ", ".join(f"h{o} long" for o in truncation.ORDERS)


def _told(rows: DataFrame, words) -> DataFrame:
    """What each pair of (row_id, msg_pos, prompt, answer) tells by itself, with hashes of the sentences and ends it asks for, and its ``place``; checkpointed, no texts."""

    def state(t: Told) -> tuple:
        hashes = truncation.tail_hashes(t.end.tail) if t.end.tail else {}
        tail = truncation._tail_key(t.end.tail) if t.end.tail else None
        return t.defect, [_key(s) for s in t.asked], t.other, t.end.kind, t.end.ask, t.end.loose, t.end.gap, tail, *[truncation._signed(hashes.get(o)) for o in truncation.ORDERS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, model = _automaton(), Model(words.value, {})
        kinds = [pa.string(), pa.list_(pa.int64()), pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), *[pa.int64()] * (1 + len(truncation.ORDERS))]
        for b in batches:
            got = [state(told(p, a, model, phrases)) for p, a in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            columns = [pa.array(c, k) for c, k in zip(zip(*got, strict=True) if got else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=[c.split()[0] for c in _STATE.split(", ")])

    return rows.mapInArrow(run, _STATE).withColumn("place", F.monotonically_increasing_id()).checkpoint()


def judge(raw: DataFrame) -> DataFrame:
    """(row_id, msg_pos, defect): every pair with its defect, null for a sound one.

    Stopwords are counted over all labelled messages; each pair is then read once, whole, where it lies; what follows the
    ends that are open, and where the sentences beside declining ones stand, is counted over all labelled messages as
    well. Only counts, hashes and places, never texts, are checkpointed, shuffled and joined. Null and missing answers are
    empty; a record without user messages has no pairs; repeated rows are judged alike; other columns are not read.
    """
    spark = raw.sparkSession
    checkpoint_dir(spark)
    rows = spread(labelled(raw))
    state = _told(spread(pairs(raw)), spark.sparkContext.broadcast(all_stopwords(rows)))
    open_ = (F.col("tail").isNotNull()) | (F.size("asked") > 0)
    tails = state.where("tail IS NOT NULL").groupBy("tail").agg(*[F.first(f"h{o}").alias(f"h{o}") for o in truncation.ORDERS])
    asked = state.select("place", F.explode("asked").alias("key"))
    beside = asked.join(_beside(rows, asked).withColumn("there", F.lit(True)), "key", "left").groupBy("place").agg(F.every(F.coalesce("there", F.lit(False))).alias("beside"))
    known = truncation._contexts(rows, tails)
    # rows without a tail are told apart by their place, so that they don't meet in one task
    met = state.where(open_).withColumn("_key", F.coalesce("tail", "place")).join(known.withColumnRenamed("tail", "_key"), "_key", "left").join(beside.where("beside"), "place", "left")
    columns = ["row_id", "msg_pos", "defect", F.size("asked").alias("asked"), "other", "kind", "ask", "loose", "gap"]
    every = met.select(*columns, F.coalesce("beside", F.lit(False)).alias("beside"), "n").unionByName(state.where(~open_).select(*columns, F.lit(False).alias("beside"), F.lit(None).cast("array<long>").alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [
                verdict(Told(plain, ("",) * n_asked, other, truncation.Ending(kind, ask, None, loose, False, gap)), sure, n)
                for plain, n_asked, other, kind, ask, loose, gap, sure, n in zip(*[c.to_pylist() for c in b.columns[2:]], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kinds, pa.string())], names=["row_id", "msg_pos", "defect"])

    return every.mapInArrow(run, "row_id long, msg_pos int, defect string")


def found_rows(raw: DataFrame) -> DataFrame:
    """(row_id, msg_pos, defect) of the defective pairs; repeated rows come out once."""
    return judge(raw).where("defect IS NOT NULL").distinct()


def counts(raw: DataFrame) -> DataFrame:
    """(defect, n_pairs): how many pairs have each defect; sound pairs under 'none'."""
    return judge(raw).groupBy(F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("n_pairs"))
