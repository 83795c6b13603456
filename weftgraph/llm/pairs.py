"""Broken prompt and response pairs: empty, refused, copied, in another language, or cut off.

* copied: a suffix automaton of the prompt's letters and digits is walked with the response's; the parts of the
  response matched for at least `LEAST_MATCH` signs are its copied part.
* refusal: automata over parts (who speaks, a negated ability or permission, what answering is called) read the first
  sentences; what others say or may not do, and what is said of the evidence, is none.
* truncated: a stack of open delimiters (code blocks, brackets, quotes) and the kind of the last line and sign.
* other language: function words of each language vote, Han characters for Chinese.

Each row is judged alone, in one pass over Arrow batches, so nothing is shuffled but repeated ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import strip

LEAST_MATCH, COPIED_SHARE = 8, 0.9
# Function words that vote for a language.
STOPWORDS = {
    "en": "the a an of to and is are was were for it its that this with by from in on at after before when which each every no not one than may must who how why where what does do did yes be has have but if only while because into without between",
    "de": "der die das den dem des ein eine einen einem einer und ist sind war wird werden nicht für mit von zu im in auf an aus bei nach vor wenn weil als wie was wer welche welcher welches warum wann wo es sich nur noch bis sobald ohne alles dann danach ja nein den ob mehr viele viel bevor so schon",
    "fr": "le la les un une des du de et est sont était il elle ne pas plus que qui quoi ce cette ces son sa ses pour par avec sans dans sur au aux dès tant quand alors puis après avant comment pourquoi quel quelle quels combien où oui non si tout en ou",
    "es": "el la los las un una de del y es son era no que quien quién qué cual cuál cómo cuando cuándo cuánto cuántas cuántos por para con sin en al se su sus lo más donde dónde tras hasta según primero solo ya pero sí si todo porque entonces",
}
# Names of languages in the five languages of the texts.
LANGUAGE_NAMES = {
    "en": "english|anglais|englisch|englische|inglés|ingles|英文|英语|英語",
    "fr": "french|français|francais|französisch|francés|frances|法文|法语|法語",
    "de": "german|allemand|deutsch|alemán|aleman|德文|德语|德語",
    "es": "spanish|espagnol|spanisch|español|espanol|castellano|西班牙文|西班牙语|西班牙語",
    "zh": "chinese|mandarin|chinois|chinesisch|chino|中文|汉语|漢語",
}
# Parts of a refusal by language: what answering is called, how it is negated, how it is declined outright.
_ACT = {
    "en": "help|assist|answer|answering|comply|discuss|discussing|say|tell|talk|comment|commenting|provide|providing|respond|responding|share|sharing|engage|speak|fulfill|do that|do this|do so|go into|weigh in|continue with|give (?:you )?(?:an |any )?(?:answer|information|advice)",
    "de": "beantworten|antworten|sagen|helfen|weiterhelfen|äußern|auskunft|mitteilen|besprechen|eingehen|kommentieren|sprechen|reden|nachkommen|behilflich sein|antwort geben",
    "fr": "répondre|aider|prononcer|parler|dire|fournir|commenter|discuter|traiter|renseigner|assister|donner suite|donner de réponse",
    "es": "ayudar\\w*|responder\\w*|contestar\\w*|hablar|decir\\w*|comentar\\w*|proporcionar\\w*|compartir|discutir|tratar|atender|opinar|dar (?:una )?respuesta",
    "zh": "回答|作答|提供|讨论|处理|帮助|帮您|帮你|协助|评论|透露|告知|谈论|答复|回应|满足",
}
_SELF = "(?:i|we)(?: (?:m|am|are|ve|have|d|would|ll|will|must|do|really|unfortunately|simply|regretfully|respectfully|therefore|just|also|still|sadly|can|may|should|feel|fear|think|believe|need to|have to|going to|and|so|to|afraid(?: that)? i)){0,5}?"
_NOT = "(?:can t|cannot|can not|could not|couldn t|won t|will not|wouldn t|would not|may not|must not|unable to|not able to|not allowed to|not permitted to|not authori[sz]ed to|not comfortable|not willing to|not going to|not in a position to|don t feel comfortable|do not feel comfortable|uncomfortable|not free to|not at liberty to|rather not|prefer not to|no permission to|not be able to|choose not to|be unable to)"
_GAP = "(?: \\w+){0,%d}?"
_MODAL = "(?:kann|darf|möchte|werde|will|könnte|dürfte|können|dürfen|möchten|werden|vermag)"
REFUSAL = {
    "en": [
        rf"{_SELF} {_NOT}{_GAP % 4} (?:{_ACT['en']})", rf"{_SELF}(?: (?:must|have to|need to|will|am going to|respectfully|politely|chose to|choose to))* (?:decline|refuse|pass on|abstain|say no)",
        rf"(?:{_ACT['en']}){_GAP % 4} (?:is|are) (?:not something|nothing) (?:i|we) (?:m|am|are|can|may|could)", r"(?:outside|beyond|against|exceeds) (?:of )?(?:what|the things|the topics|the scope of what) (?:i|we) (?:may|can|am|m|are|could)",
        r"(?:something|one|request|question|topic) (?:that )?(?:i|we) (?:must|have to|will|need to) (?:decline|refuse|pass on|leave)",
    ],
    "de": [
        rf"(?:{_MODAL}(?: \w+){{0,2}}? (?:ich|wir)|(?:ich|wir) {_MODAL}){_GAP % 7} (?:nicht|nichts|kein\w*){_GAP % 4} (?:{_ACT['de']})", r"muss(?: \w+){0,2}? (?:ich|wir)(?: \w+){0,5}? (?:ablehnen|verweigern|passen)", r"(?:ich|wir) (?:muss|müssen)(?: \w+){0,6}? (?:ablehnen|verweigern|passen)",
        r"(?:ich|wir) (?:lehne|lehnen|verweigere|verweigern) (?:\w+ ){0,5}?(?:ab|antwort|auskunft)", r"(?:mir|uns) ist es nicht (?:erlaubt|gestattet|möglich)",
    ],
    "fr": [
        rf"(?:je|nous) (?:ne|n){_GAP % 7} (?:{_ACT['fr']})", r"(?:je|nous) (?:\w+ ){0,2}?(?:refuse|refusons|décline|préfère ne pas|préférons ne pas|dois refuser|dois décliner|m abstiens)", r"(?:m|nous) est (?:interdit|impossible|défendu)", r"(?:je|nous) (?:ne|n) (?:ai|suis|sommes|avons) pas (?:le droit|autorisés?|en mesure)",
    ],
    "es": [
        rf"no (?:me |le |te |lo |les |os |nos )?(?:puedo|podemos|debo|debemos|quiero|deseo|voy a|vamos a|estoy|estamos|tengo|tenemos){_GAP % 5} (?:{_ACT['es']})", rf"no (?:me|nos) (?:está|es) (?:permitido|posible){_GAP % 2} (?:{_ACT['es']})", rf"(?:prefiero|preferimos|elijo) no (?:{_ACT['es']})", r"(?:debo|debemos|tengo que) (?:rechazar|declinar)", r"me niego a|me abstengo de|(?:declino|rechazo) (?:responder|contestar|esta|la)",
    ],
    "zh": [rf"(?:我|我们|本助手|恕|抱歉|对不起|很遗憾|不好意思)[^。！？；!?]{{0,12}}?(?:无法|不能|不便|不予|拒绝|没有权限|不可以|无权|不想|不会|不愿)[^。！？；!?]{{0,6}}?(?:{_ACT['zh']})", rf"^\W*(?:无法|不便|恕不)(?:就此|对此)?(?:{_ACT['zh']})", "无可奉告"],
}
#: Sentences with which a refusal begins, and the least share of the answer's words it makes up.
FIRST, SHARE = 2, 0.25
#: An answer that says what the evidence shows, or does not, is no refusal.
_EVIDENCE = re.compile(r"\b(?:evidence|excerpts?|passages?|sources?|documents?|cited|citations?|provided|notes|lines|context|auszug|quellen?|belege?n?|zitiert\w*|extraits?|preuves?|pruebas?|fuentes?|fragmentos?|citad\w+)\b|证据|原文|引文|文档|材料")
# Stand-ins for nothing.
NOTHING = frozenset("n a|na|null|none|nil|nan|undefined|empty|no answer|tbd|todo|keine|aucune|aucun|ninguna|ninguno|nada|nichts|rien|无|没有|暂无|空".split("|"))
_CITATION = re.compile(r"\[(?:raw|ref|src|doc|cite|source)?:?\s*[0-9a-f]{6,}\]|\[\^?\d{1,3}\]|【\d+[^】]*】|\[(?:raw|ref|src|doc|cite|source):[^\]\n]*\]", re.I)
_INVISIBLE = re.compile("[\u00ad\u180e\u200b-\u200f\u2060-\u2064\ufeff\ufe0f]")
_CODE_BLOCK = re.compile(r"```.*?(?:```|\Z)", re.S)
_CODE_SPAN = re.compile(r"`[^`\n]*`")
_IDENTIFIER = re.compile(r"[A-Za-z0-9]+(?:[_.][A-Za-z0-9]+)+|[A-Za-z]*\d[A-Za-z0-9]*")
_LABEL = re.compile(r"^[\s>*#_]*(?:question|query|prompt|frage|pregunta|问题|提问|q)\s*[:：]", re.I)
_HAN = re.compile(r"[㐀-䶿一-鿿]")
_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|[。！？]|\n+")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“\n]*“|「[^」\n]*」")
_ALNUM = re.compile(r"[\W_]+")
_VOTES: dict[str, list[str]] = {}
for _lang, _list in STOPWORDS.items():
    for _w in _list.split():
        _VOTES.setdefault(_w, []).append(_lang)
_ASKED = {k: re.compile(rf"(?<![A-Za-zÀ-ÿ])(?:{v})(?![A-Za-zÀ-ÿ])", re.I) for k, v in LANGUAGE_NAMES.items()}
_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "】": "【", "」": "「", "》": "《", "”": "“"}
_OPENERS = frozenset(_PAIRS.values())
_FINAL = frozenset(".!?。！？;；:：")
_CUT = re.compile(r"(?:…|\.\.\.|\[(?:cut|truncated|\.\.\.|…|continued|more)\]|<\|?(?:cut|eos|endoftext)\|?>)\s*$", re.I)
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])(?:\s+|$)")
_NUMBERS = {"two": 2, "three": 3, "four": 4, "five": 5, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "两": 2, "三": 3, "四": 4, "五": 5}
_STEPS = re.compile(rf"^\W*({'|'.join(_NUMBERS)})[^\n.!?。]{{0,24}}[:：]\s*$", re.I | re.M)


class SuffixAutomaton:
    """All substrings of a text; `matched` says how much of another text is made of long ones."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def matched(self, text: str, least: int) -> int:
        """Signs of `text` that lie in a common substring of at least `least` signs."""
        state, length, covered, done = 0, 0, 0, 0
        for i, c in enumerate(text, 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            else:
                length = 0
            if length >= least:
                begin = max(done, i - length)
                covered += i - begin
                done = i
        return covered


def refusal_automaton() -> tuple[re.Pattern, re.Pattern]:
    """One automaton over the parts of refusals in words of letters, one over those in Han characters."""
    spaced = "|".join(f"(?:{p})" for k in ("en", "de", "fr", "es") for p in REFUSAL[k])
    return re.compile(rf"(?<!\w)(?:{spaced})(?!\w)"), re.compile("|".join(REFUSAL["zh"]))


def language(text: str) -> str | None:
    """The language most function words vote for; null where nothing or not enough speaks for one."""
    bare = _IDENTIFIER.sub(" ", _CODE_SPAN.sub(" ", _CODE_BLOCK.sub(" ", text)))
    han = len(_HAN.findall(bare))
    words = _WORDS.findall(_HAN.sub(" ", bare).lower())
    if han and han >= 0.5 * len(words):
        return "zh"
    votes = dict.fromkeys(STOPWORDS, 0)
    for w in words:
        for lang in _VOTES.get(w, ()):
            votes[lang] += 1
    first, second = sorted(votes.values(), reverse=True)[:2]
    if first == second or (first < 2 and second > 0):
        return None
    return max(votes, key=votes.__getitem__)


def is_empty(answer: str) -> bool:
    """Nothing but blanks, invisible signs, citation marks, empty code or a stand-in for nothing."""
    bare = _CITATION.sub(" ", _INVISIBLE.sub("", answer))
    plain = " ".join(_ALNUM.sub(" ", bare).lower().split())
    return not plain or plain in NOTHING


def is_copied(question: str, answer: str) -> bool:
    """The answer is made of the question's text; short answers that merely occur in it are not copies."""
    q = _ALNUM.sub("", question).lower()
    a = _ALNUM.sub("", _LABEL.sub("", _CITATION.sub(" ", answer))).lower()
    least = min(LEAST_MATCH, 4 if _HAN.search(q) else LEAST_MATCH)
    if not q or len(a) < max(least, 0.4 * len(q)):
        return False
    # each copied sign lies within `least` signs of one of these matches: few of them rule a copy out before the automaton is built
    known = {q[i : i + least] for i in range(len(q) - least + 1)}
    if sum(a[i : i + least] in known for i in range(len(a) - least + 1)) * least < COPIED_SHARE * len(a):
        return False
    return SuffixAutomaton(q).matched(a, least) >= COPIED_SHARE * len(a)


def is_truncated(answer: str) -> bool:
    """Stops inside a word, sentence, list, bracket, quote, table row or code block."""
    text = _CITATION.sub("", _INVISIBLE.sub("", answer)).rstrip()
    if not text:
        return False
    if _CUT.search(text):
        return True
    if len(re.findall(r"^[ \t>]*```", text, re.M)) % 2:
        return True
    ends_with_code = text.endswith("```")
    prose = _CODE_SPAN.sub("x", _CODE_BLOCK.sub("\n", text)).rstrip()
    if "`" in prose:
        return True
    stack = []
    for c in prose:
        if c in _OPENERS:
            stack.append(c)
        elif c in _PAIRS and stack and stack[-1] == _PAIRS[c]:
            stack.pop()
    if stack:
        return True
    steps = _STEPS.search(text)
    if steps and 0 < sum(bool(_ITEM.match(x)) for x in text[steps.end() :].split("\n")) < _NUMBERS[steps.group(1).lower()]:
        return True
    if ends_with_code or not prose:
        return False
    lines = [x for x in prose.split("\n") if x.strip()]
    last = lines[-1].strip()
    if last.startswith("|"):
        wide = [x.count("|") for x in lines if x.strip().startswith("|")]
        return not last.endswith("|") or last.count("|") < max(wide)
    tail = re.sub(r"[*_~\"'”’»)\]}）】」》]+$", "", last)
    if not tail:
        return False
    if tail[-1] in ":：" or tail[-1] in ",，、—–-(" or (_ITEM.match(last) and not _ITEM.sub("", last).strip()):
        return True
    if tail[-1] in _FINAL:
        return False
    body = _ITEM.sub("", last)
    if _ITEM.match(last):
        before = [_ITEM.sub("", x).strip() for x in lines[:-1] if _ITEM.match(x)]
        return bool(before) and all(x[-1:] in _FINAL for x in before) and len(before) > 0
    if re.match(r"^[^.!?。]{1,24}[:：]\s*\S", body) and text.endswith("`"):
        return False
    if text.endswith("`") and not text.endswith("```"):
        return False
    plain = _WORDS.findall(_HAN.sub("", body))
    return len(_HAN.findall(body)) + len(plain) > 4


def defect_of(question: str | None, answer: str | None, automaton) -> str | None:
    """The one defect of a pair, or null. A missing question leaves copies and languages undecided."""
    if answer is None or is_empty(answer):
        return "empty"
    if refuses(answer, automaton):
        return "refusal"
    if question:
        if is_copied(question, answer):
            return "copied"
        asked, given = language(question), language(answer)
        if asked and given and asked != given and not _ASKED[given].search(question):
            return "other_language"
    return "truncated" if is_truncated(answer) else None


def refuses(answer: str, automaton: tuple[re.Pattern, re.Pattern]) -> bool:
    """Whether one of the first sentences outside code and quotation marks declines in the first person, and makes up enough of the answer."""
    bare = _QUOTED.sub(" x ", _CODE_SPAN.sub(" x ", _CODE_BLOCK.sub(" ", _CITATION.sub(" ", answer))))
    sentences = [x for x in _SENTENCE.split(bare) if _ALNUM.sub("", x)]
    total = None
    for sentence in sentences[: FIRST + 1]:
        low = sentence.lower()
        words = " ".join(_ALNUM.sub(" ", low).split())
        if not (automaton[1].search(low) if _HAN.search(low) else automaton[0].search(words)):
            continue
        if _EVIDENCE.search(low):
            continue
        size = lambda t: len(_WORDS.findall(_HAN.sub(" ", t))) + len(_HAN.findall(t))
        total = total or sum(map(size, sentences))
        if size(sentence) >= SHARE * total:
            return True
    return False


def broken_pairs(df: DataFrame, key: str, question: str, answer: str, status: str) -> DataFrame:
    """key and defect (``empty``, ``refusal``, ``copied``, ``other_language``, ``truncated``) of each broken pair.

    Only rows whose status is ``ok`` in any case, without outer blanks, count; a null status is none. A null answer is
    empty. A null question makes neither a copy nor another language. A pair has at most one defect, the first of the
    order above. Repeated rows come out once; of contradicting rows of one key the first defect in alphabetical order
    counts. Texts of any length are read whole; other columns do not matter; an empty table gives an empty result.
    """
    ok = F.lower(strip(F.col(status))) == "ok"
    rows = df.where(ok).select(F.col(key).alias("key"), F.col(question).alias("question"), F.col(answer).alias("answer"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = refusal_automaton()
        for batch in batches:
            found = [defect_of(q, a, automaton) for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            at = [i for i, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([found[i] for i in at], pa.string())], names=["key", "defect"])

    return rows.mapInArrow(run, f"key {kind}, defect string").groupBy("key").agg(F.min("defect").alias("defect"))
