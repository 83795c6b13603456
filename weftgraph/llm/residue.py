"""Template residue and machine notices in texts: a linear classifier over segments.

A text without its code is cut into segments (lines, and sentences within lines). Features of a segment are hashed one- to
three-token sequences (a token is a word, a number or one sign), hashed sequences of token shapes (runs of words count as
one, capitals apart) around brackets and other signs, its length, how much of it repeats, the text's length, and whether it is a title. A logistic
regression with an L2 penalty is fitted on a bounded sample with weak labels: standard phrases of response statuses,
script notices and filler where they make up a short segment, and segments of few words said again and again; long sentences that hold such a phrase speak about it and
are harmless. A fixed list of made-up examples of each family and language stands beside the sample, so a small sample
lacks none. After a first fit, unlabelled segments that score high become positives and doubtful ones are left out, and
the model is fitted again. Hosts (skills) are split: the threshold is chosen on hosts the fit has not seen. A text is a
case if its best segment scores above the threshold; nothing else decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from http import HTTPStatus

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import vectext

#: Documents the classifier is fitted on: those with the smallest hashes of their id. A bound on the fit alone.
SAMPLE_DOCS = 2_500
BITS = 18
PENALTY = 4e-5
ROUNDS, RATE = 80, 0.2
#: Least weight of a feature: many harmless words must not outweigh one placeholder among them.
LEAST = -0.02
#: After each of these fits an unlabelled segment above the first score is a positive of the next; between the two it is left out.
STEPS = ((1.5, -3.2), (0.5, -2.8))
#: Weight of an unlabelled segment in the first fit: it may be a case without a known phrase.
DOUBT = 0.3
#: Where unseen hosts decide nothing, and how far they may raise the threshold: never lower it, since below 0 a segment is more likely harmless and their labels are weak.
THRESHOLD, REACH = 0.0, 1.5
#: Weights against one unlabelled segment: of a weakly labelled positive, of one that speaks about such things, of a made-up example, of a harmless sentence that examples are put into.
POSITIVE, SPEAKS, SEED, CALM = 8.0, 60.0, 5.0, 3.0

_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,}).*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_INLINE = re.compile(r"(`+)[^`\n]+\1")
_CODE = ""
_TAG = re.compile(r"</?(?:a|b|i|u|p|em|br|hr|h[1-6]|li|ul|ol|td|th|tr|div|span|strong|table|sup|sub)(?:\s[^<>]*)?/?>", re.I)

# Phrases of response statuses (published with the protocol), and standard phrases of each family by language.
REASONS = sorted(s.phrase.lower() for s in HTTPStatus if s >= 400)
PHRASES = {
    ("script", "en"): r"(?:enable|activate|turn on|allow|requires?|without|needs?) (?:java)?scripts?|javascript (?:is|must be|has been|seems to be|to be) \w+",
    ("script", "de"): r"javascript (?:ist|muss|bitte|im browser|zu aktivieren|aktivieren)|aktivieren sie (?:bitte )?(?:java)?scripts?|skripte",
    ("script", "fr"): r"(?:activer|activez|autoriser) (?:le )?(?:java)?scripts?|javascript (?:est|doit)",
    ("script", "es"): r"(?:activ\w+|habilit\w+|permit\w+) (?:el )?(?:java)?scripts?|javascript (?:está|debe)",
    ("script", "zh"): r"(?:启用|开启|打开|允许|禁用)了?\s*(?:javascript|脚本)|(?:javascript|脚本)\s*(?:已|被|功能)",
    ("missing", "en"): r"(?:page|url|site|file|resource|address) (?:was |is |could |can)?(?:not|cannot|no longer|n.t) (?:be )?(?:found|exists?|available)|(?:couldn.t|can.t|cannot|unable to) find (?:the|that|this) (?:page|site)|page not found",
    ("missing", "de"): r"seite (?:wurde |konnte )?nicht gefunden|seite existiert nicht",
    ("missing", "fr"): r"page (?:est )?introuvable|page (?:demandée )?n.existe pas|page non trouvée",
    ("missing", "es"): r"página no (?:fue )?encontrada|página no existe|no se (?:ha )?encontr\w+ la página",
    ("missing", "zh"): r"页面不存在|页面已被?删除|找不到.{0,6}页面|页面未找到",
    ("denied", "en"): r"(?:access|permission) (?:is |was |has been )?denied|(?:not have|no|n.t have) permission|not authorized to (?:view|access)",
    ("denied", "de"): r"(?:zugriff|zugang) verweigert|keine berechtigung",
    ("denied", "fr"): r"accès (?:refusé|interdit)|pas (?:la permission|autorisé)",
    ("denied", "es"): r"acceso (?:denegado|prohibido)|no tiene permiso",
    ("denied", "zh"): r"访问被拒绝|拒绝访问|没有权限",
    ("down", "en"): r"(?:temporarily|currently) (?:unavailable|down|offline)|service unavailable|try (?:again|later)|down for maintenance|(?:internal )?server error|bad gateway|too many requests|something went wrong|an error (?:has )?occurred|connection (?:was )?(?:refused|reset|timed out)|unexpected error",
    ("down", "de"): r"nicht (?:erreichbar|verfügbar)|versuchen sie es (?:später|erneut)|interner serverfehler|wartungsarbeiten|fehler \d+",
    ("down", "fr"): r"(?:est|temporairement|momentanément) indisponible|réessay\w+ plus tard|erreur (?:interne|\d+)|en maintenance",
    ("down", "es"): r"no (?:está )?disponible|inténtelo|error interno|error \d+|en mantenimiento",
    ("down", "zh"): r"服务器(?:内部)?错误|暂时?(?:不可用|无法访问)|请稍后|请求过于频繁|系统维护|错误码",
    ("session", "en"): r"session (?:has |is )?(?:expired|timed out)|(?:sign|log) in (?:again )?to (?:continue|view|access)|verify (?:that )?you are (?:a )?human|checking your browser",
    ("session", "de"): r"sitzung ist abgelaufen|melden sie sich (?:bitte )?(?:erneut |wieder )?an",
    ("session", "fr"): r"session (?:a |est )?expirée?|veuillez vous (?:re)?connecter",
    ("session", "es"): r"sesión ha (?:expirado|caducado)|inicie sesión",
    ("session", "zh"): r"(?:会话|登录)已?过期|请重新登录",
    ("filler", "en"): r"lorem ipsum|(?:sample|dummy|placeholder|filler) (?:text|copy|content)|text (?:goes|will go|comes) ",
    ("filler", "de"): r"blindtext|platzhaltertext|mustertext|beispieltext",
    ("filler", "fr"): r"faux texte|texte (?:de remplissage|d.exemple|à remplacer)",
    ("filler", "es"): r"texto de (?:relleno|ejemplo|prueba|muestra)|aquí (?:va|irá)",
    ("filler", "zh"): r"占位(?:文字|文本|符)|示例(?:文字|文本)|测试(?:内容|文本|文字)",
}
_FAMILIES = sorted({f for f, _ in PHRASES})
_LANGUAGES = ("en", "de", "fr", "es", "zh")
_WORD = re.compile(r"[㐀-䶿一-鿿]|[^\W_㐀-䶿一-鿿]+")
_REASON = re.compile(rf"\W*(?:(?:http|error|status|code)\W*)*(?:[45]\d\d\W+)?(?:{'|'.join(map(re.escape, REASONS))})\W*")
_SIGNS = re.compile(r"[{}<>\[\]%@$（）【】《》]")
_LETTER = re.compile(r"[^\W\d_]")
_MENTION = re.compile(rf"\b[45]\d\d\s+(?:{'|'.join(map(re.escape, REASONS))})\b")
_STATUS = re.compile(r"\W*(?:(?:http|error|status|code|erreur|fehler|código|错误)\W*)+[45]\d\d\b.{0,40}|[45]\d\d\W.{0,40}", re.S)
_LATIN = re.compile(r"^\W*lorem ipsum|ipsum.*(?:ipsum|lorem|dolor|amet)|(?:dolor|amet).*ipsum")
_ANY = re.compile("|".join(PHRASES.values()))
#: A segment that a phrase may stand for has at most so many words; one with more speaks about it.
SHORT = 12
# Shapes of placeholders that leave no doubt; the weak label of the sample. %s: what is to be filled in.
_SHAPE = re.compile(r"\{\{[^{}\n]+\}\}|[$#]\{[^{}\n]+\}|\{%[^%\n]+%\}|<%[^%\n]+%>|<<[^<>\n]+>>|@@[^@\n]+@@|\[(?:INSERT|YOUR|ENTER)\b[^\]\n]+\](?!\()")
SHAPES = {
    "en": "{{ %s }}|{{%s}}|${%s}|#{%s}|{%s}|{%% %s %%}|<%%= %s %%>|<<%s>>|@@%s@@|%%%S%%|__%S__|[Your %s]|[Your %s here]|[INSERT %S]|[Insert %s here]|[Enter %s]|[%s goes here]|[%s here]|<YOUR %S>|<your %s>|<insert %s>|<enter %s>|<%s here>|TODO(%s)|TODO: %s|TBD: %s|TBD|FIXME: %s|XXXX|XXXXX|[TBD]",
    "de": "[hier %s einfügen]|[Ihr %s]|<bitte %s eintragen>|<%s einfügen>|<%s eintragen>|[%s eintragen]|[%s einfügen]|<hier %s>",
    "fr": "[votre %s]|[insérer %s]|<insérer %s>|[%s à compléter]|[à compléter : %s]|<votre %s>|[compléter %s]",
    "es": "[su %s]|[insertar %s]|<insertar %s>|[completar %s]|<completar %s>|[%s aquí]|<%s aquí>",
    "zh": "【待补充：%s】|【请填写%s】|（此处填写%s）|（待填写）|【%s】待补|（请输入%s）|【此处插入%s】|[请填写%s]",
}
#: How many words each shape is filled with; the words come from the sample, so they speak for nothing.
NAMES = 10
_PLACE = re.compile(r"[㐀-䶿一-鿿]{2}|[^\W㐀-䶿一-鿿]+(?:[._]\w+)*")
# Made-up examples of each family and language.
SEEDS = {
    ("script", "en"): "Please enable JavaScript in your browser.|JavaScript is required to use this site.|This site requires JavaScript to work.|You need to enable JavaScript to run this app.|JavaScript has been disabled in your settings.|Scripts must be allowed for this page.|Your browser does not support scripts.|Cookies and scripts are blocked, please allow them.|We're sorry, but this app doesn't work properly without JavaScript enabled.",
    ("script", "de"): "Bitte aktivieren Sie JavaScript in Ihrem Browser.|JavaScript ist deaktiviert.|Diese Seite benötigt JavaScript.|Ihr Browser blockiert Skripte.|Für diese Anwendung müssen Skripte erlaubt sein.",
    ("script", "fr"): "Veuillez activer JavaScript dans votre navigateur.|JavaScript est désactivé.|Ce site nécessite JavaScript.|Cette application a besoin de scripts.",
    ("script", "es"): "Habilite JavaScript en su navegador.|JavaScript está desactivado.|Este sitio necesita JavaScript.|Active los scripts para continuar.",
    ("script", "zh"): "请在浏览器中启用 JavaScript。|JavaScript 已被禁用。|本页面需要 JavaScript 支持。|您的浏览器不支持脚本。|请允许脚本运行后继续。",
    ("missing", "en"): "404 Not Found|Page not found|Error 404: page not found|The page you requested could not be found.|The requested URL was not found.|This page is not available.|Sorry, this page doesn't exist.|We can't find that page.|We couldn't find what you were looking for.|The file has been removed or never existed.|Oops! Nothing here.|410 Gone",
    ("missing", "de"): "Seite nicht gefunden|Fehler 404|Fehler 404: Die Seite wurde nicht gefunden.|Die angeforderte Seite existiert nicht.|404 Nicht gefunden",
    ("missing", "fr"): "Page introuvable|Erreur 404|Erreur 404 : page non trouvée|La page demandée n'existe pas.|404 Introuvable",
    ("missing", "es"): "Página no encontrada|Error 404|Error 404: la página no existe|La página solicitada no existe.|404 No encontrado",
    ("missing", "zh"): "页面不存在|404 找不到页面|您访问的页面不存在。|页面未找到|该页面已被移除。|404 未找到",
    ("denied", "en"): "Access denied|403 Forbidden|Permission denied|You do not have permission to access this page.|You are not authorized to view this resource.|401 Unauthorized|Access to this page has been denied.",
    ("denied", "de"): "Zugriff verweigert|Sie haben keine Berechtigung für diese Seite.|Zugang verweigert|403 Verboten",
    ("denied", "fr"): "Accès refusé|Accès interdit|Vous n'avez pas la permission de voir cette page.|403 Interdit",
    ("denied", "es"): "Acceso denegado|No tiene permiso para ver esta página.|Acceso prohibido|403 Prohibido",
    ("denied", "zh"): "访问被拒绝|拒绝访问|您没有权限访问此页面。|403 禁止访问|权限不足，无法查看。",
    ("down", "en"): "503 Service Unavailable|502 Bad Gateway|500 Internal Server Error|504 Gateway Timeout|Error 500|429 Too Many Requests|Too many requests, please slow down.|Service temporarily unavailable.|Please try again later.|Something went wrong.|An unexpected error occurred while loading the page.|Could not connect to the server: timeout|Could not connect to the database.|We are down for maintenance.|Reload this page.|Reference id: 17|Trace id: 9|Error code: 17",
    ("down", "de"): "Interner Serverfehler|Der Server ist derzeit nicht erreichbar.|Der Dienst ist vorübergehend nicht verfügbar.|Bitte versuchen Sie es später erneut.|Fehler 500|Fehler 503: Dienst nicht verfügbar|Es ist ein Fehler aufgetreten.|Zu viele Anfragen",
    ("down", "fr"): "Erreur interne du serveur|Le service est indisponible.|Service temporairement indisponible|Veuillez réessayer plus tard.|Erreur 500|Erreur 503 : service indisponible|Une erreur est survenue.|Trop de requêtes",
    ("down", "es"): "Error interno del servidor|El servicio no está disponible.|Servicio no disponible|Servicio temporalmente no disponible|Inténtelo de nuevo más tarde.|Error 500|Error 503: servicio no disponible|Se ha producido un error.|Demasiadas solicitudes",
    ("down", "zh"): "服务器内部错误|服务暂时不可用|请稍后再试。|系统维护中，请稍后重试。|请求过于频繁，请稍后再试。|错误码 500|发生未知错误。",
    ("session", "en"): "Your session has expired.|Session timed out.|Please log in to continue.|Please sign in again.|Log in to view this page.|Verify you are human.|Checking your browser before accessing the site.|Checking if the connection is secure",
    ("session", "de"): "Ihre Sitzung ist abgelaufen.|Bitte melden Sie sich an.|Bitte erneut anmelden.",
    ("session", "fr"): "Votre session a expiré.|Veuillez vous connecter.|Veuillez vous identifier de nouveau.",
    ("session", "es"): "Su sesión ha expirado.|Inicie sesión para continuar.|Vuelva a iniciar sesión.",
    ("session", "zh"): "会话已过期，请重新登录。|请登录后继续。|登录已过期。",
    ("filler", "en"): "Lorem ipsum dolor sit amet, consectetur adipiscing elit.|Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.|Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris.|Duis aute irure dolor in reprehenderit in voluptate velit esse cillum.|Excepteur sint occaecat cupidatat non proident, sunt in culpa.|This is placeholder text.|Sample text|Dummy text, to be replaced.|Placeholder copy goes here.|Placeholder, please replace.|Your text goes here.|Text will go in here.|Replace this text later.|Insert your content here.|This is a sample paragraph.|qwerty qwerty|blah blah blah|foo bar foo bar|test test test",
    ("filler", "de"): "Dies ist ein Blindtext.|Platzhaltertext|Hier steht ein Beispieltext.|Hier kommt später Text hin.|Mustertext|Beispieltext Beispieltext",
    ("filler", "fr"): "Ceci est un faux texte.|Texte d'exemple à remplacer.|Texte de remplissage|Le texte viendra ici.",
    ("filler", "es"): "Este es un texto de relleno.|Texto de relleno|Texto provisional|Texto de ejemplo|Texto de prueba|Aquí va el texto.|Reemplace este texto",
    ("filler", "zh"): "这是占位文字。|示例文本|测试内容测试内容|此处为示例文字，请替换。|文字内容待替换。",
}
# Made-up sentences that speak about such things.
HARMLESS = (
    "The page says that access was denied when the token is missing.|Benchmarks take lorem ipsum of a fixed length as input.|The editor fills new pages with lorem ipsum until someone writes them."
    "|A service that is unavailable counts as failed after a minute.|The template engine replaces every placeholder at build time."
    "|Users who are not found in the table get a new row.|The session expires after ten minutes.|Sessions that expired are removed each night.|Retry after the lease has ended.|The error page of the gateway names the failed host.|See [the guide](docs/guide.md) for more.|Compare rows [4, 8] with row (3, 5).|As [12] says, the list [a, b] is closed.|The set {1, 2} lies in {0, 1, 2, 3}.|Values <= 4 and >= 2 count.|- [ ] check the list|- [x] done|Use <https://example.org> as base.|Values between 10% and 20% are fine."
).split("|")


def without_code(text: str) -> str:
    """`text` without HTML tags of plain marking, and with each code block and code span as one sign."""
    if "<" in text:
        text = _TAG.sub("", text)
    if "`" in text or "~~~" in text:
        text = _INLINE.sub(_CODE, _FENCE.sub(_CODE, text))
    return text


def segments(text: str) -> list[str]:
    """The segments of a text from which code was taken."""
    codes = vectext.code_points(text)
    if not len(codes):
        return []
    ends = np.flatnonzero(_breaks(codes)) + 1
    cuts = [0, *ends.tolist(), len(text)]
    return [s for a, b in zip(cuts, cuts[1:]) if (s := text[a:b].strip())]


def _breaks(codes: np.ndarray) -> np.ndarray:
    """Signs after which a new segment begins."""
    after = np.zeros_like(codes)
    after[:-1] = codes[1:]
    blank = (after <= 32) | (after == 0xA0)
    stop = ((codes == 46) | (codes == 33) | (codes == 63)) & blank
    return (codes == 10) | (codes == 13) | (codes == 0) | stop | (codes == 0x3002) | (codes == 0xFF01) | (codes == 0xFF1F)


@lru_cache(1)
def _phrases() -> dict[tuple[str, str], re.Pattern]:
    return {k: re.compile(v) for k, v in PHRASES.items()}


def _length(text: str) -> float:
    """Words; a Han character counts as half of one."""
    return sum(0.5 if "㐀" <= w <= "鿿" else 1 for w in _WORD.findall(text))


def weak_label(segment: str, left_out: str | None = None) -> bool | None:
    """True where a status or a standard phrase makes up a short segment, or a placeholder's shape is beyond doubt; False where a long sentence speaks of one; else null. `left_out`: a family or language whose phrases are not used."""
    if not _LETTER.search(segment):
        return False
    if left_out != "shapes" and _SHAPE.search(segment):
        return True
    low = segment.lower()
    if left_out not in ("en", "down", "missing", "denied") and _REASON.fullmatch(low):
        return True
    if left_out not in ("filler", "en") and _LATIN.search(low):
        return True
    if left_out not in ("filler", "en") and len(found := _WORD.findall(low)) >= 6 and len(set(found)) <= 3:
        return True
    words = _length(low)
    if words > SHORT and _MENTION.search(low):
        return False
    if not _ANY.search(low):
        return None
    status = left_out not in ("down", "missing", "denied") and words <= 8 and _STATUS.fullmatch(low) is not None
    for key, pattern in _phrases().items():
        if left_out not in key and (m := pattern.search(low)):
            if words > SHORT:
                return False
            if status or _length(m.group(0)) >= 0.25 * words:
                return True
    return None


@lru_cache(1)
def _case() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case of each code point, whether a sign makes a sequence of shapes worth a feature, and whether it is no part of a segment it begins."""
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x41, 0x10400):
        if not 0xD800 <= c < 0xE000 and len(x := chr(c).lower()) == 1:
            lower[c] = ord(x)
    special = np.zeros(0x110000, bool)
    special[[ord(c) for c in "{}<>[]()%@$#_（）【】《》「」［］｛｝〈〉"]] = True
    marker = np.zeros(0x110000, bool)
    marker[[ord(c) for c in "#>-*+|"]] = True
    return lower, special, marker


@dataclass
class Features:
    """Feature numbers of segments in groups: `groups` holds (slot, segment) arrays; `text`: each segment's text."""

    groups: list[tuple[np.ndarray, np.ndarray]]
    text: np.ndarray

    def __len__(self) -> int:
        return len(self.text)


_M = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(64 - BITS)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h * _M >> _TOP).astype(np.int32)


def _shifted(values: np.ndarray, new: np.ndarray, first: np.uint64) -> np.ndarray:
    """The value before each, `first` at the start of a segment."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[new] = first
    return out


def features(texts: list[str]) -> Features:
    """Hashed features of all segments of texts without code."""
    codes = vectext.code_points("\x00".join(texts) + "\x00")
    if len(codes) <= len(texts):
        return Features([], np.zeros(0, np.int64))
    lower, special, marker = _case()
    low = lower[codes]
    starts, ends = vectext.cut_words(low)
    token = vectext.span_hashes(low, starts, ends)
    first = low[starts]
    kind = vectext._tables()[0][low]
    number = (first >= 48) & (first <= 57)
    token[number] = np.uint64(7)
    capitals = np.concatenate([[0], np.cumsum(low != codes)])
    upper = (capitals[ends] - capitals[starts] == ends - starts) & (ends - starts > 1)
    shape = np.where(number, 3, np.where(kind[starts] == 2, 4, np.where(upper, 2, 1))).astype(np.uint64)
    signs = np.flatnonzero((kind == 0) & (codes > 32) & (codes != 0xA0) & (codes != 0x3000))
    at = np.concatenate([starts, signs])
    order = np.argsort(at, kind="stable")
    at = at[order]
    if not len(at):
        return Features([], np.zeros(0, np.int64))
    every = np.concatenate([token, vectext.mix(codes[signs].astype(np.uint64) + np.uint64(1 << 40))])[order]
    shape = np.concatenate([shape, codes[signs].astype(np.uint64) + np.uint64(16)])[order]
    brk = _breaks(codes)
    seg = (np.cumsum(brk) - brk)[at]
    new = np.ones(len(seg), bool)
    new[1:] = seg[1:] != seg[:-1]
    titles = np.zeros(int(seg[-1]) + 1, bool)
    titles[seg[new]] = every[new] == vectext.mix(np.array([35 + (1 << 40)], np.uint64))[0]
    while (lead := new & marker[np.where(shape >= 16, shape - np.uint64(16), 0).astype(np.int64)]).any():
        at, every, shape, seg = at[~lead], every[~lead], shape[~lead], seg[~lead]
        if not len(seg):
            return Features([], np.zeros(0, np.int64))
        new = np.ones(len(seg), bool)
        new[1:] = seg[1:] != seg[:-1]
    titled = titles[seg[new]]
    seg = (np.cumsum(new) - 1).astype(np.int32)
    begin = np.flatnonzero(new)
    count = len(begin)
    text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    text = np.searchsorted(text_at, at[begin], side="right") - 1
    last = np.append(new[1:], True)
    bos, eos = np.uint64(11), np.uint64(13)
    prev = _shifted(every, new, bos)
    prev2 = _shifted(prev, new, bos)
    groups = [(_slots(every), seg), (_slots((prev * _M + every) * _M), seg), (_slots((prev2 * _M + prev) * _M + every + np.uint64(1)), seg)]
    which = np.arange(count, dtype=np.int32)
    ending = (every[last] * _M + eos) * _M
    ending2 = ((prev[last] * _M + every[last]) * _M + eos) * _M + np.uint64(5)
    size = np.diff(np.append(begin, len(seg)))
    again = np.add.reduceat(((every == prev) | (every == prev2) | (every == _shifted(prev2, new, bos))) & (shape < 16), begin)
    repeats = np.minimum(again * 5 // size, 4) * (size > 4)
    length = np.minimum(np.log2(size + 1) * 2, 14).astype(np.int64)
    doc_length = np.minimum(np.log2(np.diff(text_at) + 1).astype(np.int64), 16)[text]
    for extra in (ending, ending2, np.uint64(1 << 50) + (length + 16 * titled).astype(np.uint64), np.uint64(1 << 52) + repeats.astype(np.uint64), np.uint64(1 << 51) + (np.minimum(doc_length, 9) * 16 + length).astype(np.uint64)):
        groups.append((_slots(extra), which))
    # shapes: a run of words, capitals, numbers or Han characters counts as one
    keep = new.copy()
    keep[1:] |= (shape[1:] != shape[:-1]) | (shape[1:] >= 16)
    s, owner, fresh = shape[keep], seg[keep], new[keep]
    mark = special[np.where(s >= 16, s - np.uint64(16), 0).astype(np.int64)]
    closing = np.append(fresh[1:], True)
    window, near = s * _M, mark
    back, was = s, mark
    for k in range(2, 6):
        back = _shifted(back, fresh, bos)
        was = np.concatenate([[False], was[:-1]]) & ~fresh
        near = near | was
        window = (window + back) * _M + np.uint64(k)
        if k > 2:
            groups.append((_slots(window[near]), owner[near]))
            end = near & closing
            groups.append((_slots(window[end] * _M + eos), owner[end]))
    return Features(groups, text)


@dataclass
class Model:
    """Weights with bias, the threshold and how it did on hosts the fit had not seen."""

    weights: np.ndarray
    bias: float
    threshold: float
    report: dict[str, float]

    def scores(self, f: Features) -> np.ndarray:
        z = np.full(len(f), self.bias)
        for slot, seg in f.groups:
            z += np.bincount(seg, self.weights[slot], minlength=len(f))
        return z


def _fit(f: Features, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty, by gradient steps whose size adapts to each feature."""
    slot = np.concatenate([s for s, _ in f.groups])
    seg = np.concatenate([g for _, g in f.groups])
    used, slot = np.unique(slot, return_inverse=True)
    w = np.zeros(len(used) + 1)
    w[-1] = -3.0
    slope, square = np.zeros(len(w)), np.zeros(len(w))
    for k in range(1, ROUNDS + 1):
        z = w[-1] + np.bincount(seg, w[slot], minlength=len(f))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        g = np.append(np.bincount(slot, error[seg], minlength=len(used)) + PENALTY * len(f) * w[:-1], error.sum())
        slope += 0.1 * (g - slope)
        square += 0.01 * (g * g - square)
        step = RATE * (1 - 0.9 * k / ROUNDS) * (slope / (1 - 0.9**k)) / np.sqrt(square / (1 - 0.99**k) + 1e-6)
        w -= step
        np.maximum(w[:-1], LEAST, out=w[:-1])
    whole = np.zeros(1 << BITS, np.float32)
    whole[used] = w[:-1]
    return whole, float(w[-1])


def _inserted(sentence: str, filled: str, k: int) -> str:
    """A sentence with one of its words, or two Han characters, replaced."""
    spots = [m.span() for m in _PLACE.finditer(sentence)] or [(0, 0)]
    a, b = spots[k % len(spots)]
    return sentence[:a] + filled + sentence[b:]


def _shape_seeds(plain: list[str], languages: tuple[str, ...], part: slice = slice(None)) -> list[str]:
    """Placeholders for words of harmless sentences: alone, as item, title and table cell, and within such sentences in place of one word."""
    out, k = [], 0
    for lang in languages:
        for shape in SHAPES[lang].split("|")[part]:
            for _ in range(NAMES):
                found = _WORD.findall(plain[(k * 53 + 7) % len(plain)]) or ["name"]
                at = k % len(found)
                name = ("_", " ", " ")[k % 3].join(found[at : at + 1 + k % 2])
                filled = shape.replace("%%", "\x01").replace("%S", name.upper()).replace("%s", name).replace("\x01", "%")
                out += [filled, f"# {filled}", _inserted(f"# {plain[(k * 29 + 5) % len(plain)][:40]}", filled, k + 1), f"| {'_'.join(found[:2])} | {filled} |"]
                out += [_inserted(plain[(k * 37 + j * 11) % len(plain)], filled, k + j) for j in range(5 if "%" in shape else 40)]
                k += 1
    return list(dict.fromkeys(out))


def _calm(sentence: str, k: int) -> str:
    """A harmless sentence in one of the forms that sentences take: with a marked or linked word, as an item, in capitals."""
    word = (_PLACE.findall(sentence) or ["x"])[k % max(1, len(_PLACE.findall(sentence)))]
    form = ("{}", "_{}_", "**{}**", "[{}](notes/list.md)", "({})", "\"{}\"", "{}", "{0}_{0}_{0}", "{0}.{0}7")[k % 9]
    out = _inserted(sentence, form.format(word), k)
    return out.upper() if k % 5 == 0 else f"# {out}" if k % 5 == 1 else out


def train(rows: list[tuple[str, str]], left_out: str | None = None) -> Model:
    """A model from (host, text) rows; every fifth host is kept out of the fit. `left_out`: a family or language that neither labels nor examples may show, or ``shapes``: every second shape."""
    texts, unseen = [], []
    for host, text in rows:
        for s in segments(without_code(text)):
            texts.append(s)
            unseen.append(hash_of(host) % 5 == 0)
    unseen = np.array(unseen, bool)
    said = [weak_label(s, left_out) for s in texts]
    label = np.array([x is True for x in said], bool)
    plain = [s for s, y, u in zip(texts, said, unseen) if y is None and not u and 5 <= _length(s) <= 40 and not _SIGNS.search(s)][:2_000] or ["The owner signs the header and the hub stores it."]
    seeds = [s for key, many in SEEDS.items() if left_out not in key for t in many.split("|") for s in (t, t.upper(), f"# {t}")]
    if left_out not in ("en", "down", "missing", "denied"):
        seeds += [form.format(s.value, s.phrase) for s in HTTPStatus if s >= 400 for form in ("{} {}", "HTTP {} {}", "Error {}: {}")]
    fixed_seeds = len(seeds)
    seeds += _shape_seeds(plain, tuple(x for x in _LANGUAGES if x != left_out), slice(0, None, 2) if left_out == "shapes" else slice(None))
    calm = [_calm(t, k + j) for j in (0, 4) for k, t in enumerate(plain)] + [" ".join(t.split(" ")[k % 3 :][: 3 + k % 4]) for k, t in enumerate(plain)]
    calm += [form.format("_".join(w[:2]), w[-1], 7 * k) for k, t in enumerate(plain) if (w := _WORD.findall(t)) for form in ("| {0} | {2} |", "# {1} {0}")]
    every = [*texts, *seeds, *HARMLESS, *calm]
    fixed = len(seeds) + len(HARMLESS)
    free = np.array([x is None for x in said] + [False] * fixed + [True] * len(calm), bool)
    y = np.concatenate([label, np.ones(len(seeds), bool), np.zeros(len(HARMLESS) + len(calm), bool)])
    uses = (len(seeds) - fixed_seeds) / len(plain)
    known = np.array([POSITIVE if x else 1.0 if x is None else SPEAKS if _LETTER.search(s) else 1.0 for x, s in zip(said, texts)] + [SEED] * len(seeds) + [SPEAKS] * len(HARMLESS) + [max(CALM, SEED * uses / 2)] * len(calm))  # as much as the examples that were put into the sentences
    own = np.arange(len(every)) < len(texts)
    weight = np.where(free & own, known * DOUBT, known)
    fit = np.concatenate([~unseen, np.ones(len(every) - len(texts), bool)])
    f = features_of_segments(every)
    seen = _rows(f, fit)
    for sure, doubtful in STEPS:
        w, bias = _fit(seen, y[fit].astype(float), weight[fit])
        z = Model(w, bias, 0.0, {}).scores(f)
        # unlabelled segments the fit is sure of become positives, those it doubts are left out
        y[free & own] = z[free & own] > sure
        weight[free] = np.where(y[free], POSITIVE / 2, np.where(z[free] > np.where(own[free], doubtful, sure), 0.0, known[free]))
    w, bias = _fit(seen, y[fit].astype(float), weight[fit])
    model = Model(w, bias, THRESHOLD, {})
    z = model.scores(f)
    held = np.zeros(len(every), bool)
    held[: len(texts)] = unseen
    held &= weight > 0
    model.threshold = _threshold(z[held], y[held])
    got = z > model.threshold
    hit = float((got & held & y).sum())
    model.report = {
        "segments_fitted": float(fit.sum()), "segments_unseen": float(held.sum()), "positives_unseen": float((held & y).sum()),
        "recall_unseen": hit / max(1.0, float((held & y).sum())), "precision_unseen": hit / max(1.0, float((got & held).sum())), "threshold": model.threshold,
    }
    return model


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The least threshold from 0 on with the best balance of precision and recall on unseen hosts."""
    if not y.any() or y.all():
        return THRESHOLD
    tries = np.linspace(THRESHOLD, REACH, 31)
    pos, neg = np.sort(z[y]), np.sort(z[~y])
    hit = len(pos) - np.searchsorted(pos, tries, side="right")
    wrong = len(neg) - np.searchsorted(neg, tries, side="right")
    f1 = 2 * hit / np.maximum(len(pos) + hit + wrong, 1)
    best = tries[f1 >= f1.max() - 1e-9]
    return float(np.clip(THRESHOLD, best.min(), best.max()))


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def _rows(f: Features, keep: np.ndarray) -> Features:
    number = np.cumsum(keep) - 1
    return Features([(s[keep[g]], number[g[keep[g]]]) for s, g in f.groups], f.text[keep])


def features_of_segments(texts: list[str]) -> Features:
    """Features where each text is one segment: inner breaks are read as blanks."""
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for low, high in vectext.chunks(texts):
        f = features([re.sub(r"[\r\n\x00]|(?<=[.!?])\s|[。！？](?=.)", " ", s) for s in texts[low:high]])
        parts.append([(s, (f.text[g] + low).astype(np.int64)) for s, g in f.groups])
    groups = [(np.concatenate([p[k][0] for p in parts if p]), np.concatenate([p[k][1] for p in parts if p])) for k in range(max(map(len, parts), default=0))]
    return Features(groups, np.arange(len(texts)))


def sample(documents: DataFrame, doc_id: str, text: str, host: str, n: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """At most `n` (host, text) rows, those with the smallest hash of the id.

    Tasks send only rows whose hash lies in the share of all hashes that holds about 2 `n` rows, so what reaches the
    driver does not grow with the number of tasks.
    """
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.lit("sample")), 1)
    share = min(1.0, 2 * n / max(1, documents.count()))
    rows = documents.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("h"), F.col(text).alias("t"), hashed.alias("o")).where("t is not null and t <> ''")
    near = rows if share == 1 else rows.where(F.col("o") < int(share * (1 << 63)))
    return [(r.h, r.t) for r in near.orderBy("o", "t").limit(n).collect()]


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    """The score of each text's best segment; minus infinity where it has none."""
    bare = [without_code(t) for t in texts]
    best = np.full(len(texts), -np.inf)
    for low, high in vectext.chunks(bare):
        f = features(bare[low:high])
        np.maximum.at(best, low + f.text, model.scores(f))
    return best


def residue(documents: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """doc_id and score (of the best segment) of the texts with template residue, filler or a machine notice.

    Null and empty texts, and texts of nothing but code, are no case. Ids that come twice come out once, with the
    higher score. Texts of any length are read whole. Other columns do not matter; an empty table gives an empty
    result. The fit uses at most `SAMPLE_DOCS` rows; every row is scored.
    """
    model = train(sample(documents, doc_id, text, host))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null and text <> ''")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            best = score_texts(model, batch.column(1).to_pylist())
            found = np.flatnonzero(best > model.threshold)
            if len(found):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found)), pa.array(best[found])], names=["doc_id", "score"])

    found = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return found.groupBy("doc_id").agg(F.max("score").alias("score"))


def examples(left_out: str) -> list[str]:
    """The made-up examples of a family or a language, or of every second shape."""
    if left_out == "shapes":
        return _shape_seeds(["The owner signs the header and the hub stores it."], _LANGUAGES, slice(1, None, 2))
    many = [t for key, x in SEEDS.items() if left_out in key for t in x.split("|")]
    return many + (_shape_seeds(["The owner signs the header and the hub stores it."], (left_out,)) if left_out in _LANGUAGES else [])


def validation(documents: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """measure and value: precision and recall on unseen hosts, and for each family and language the recall of a model that has seen neither its labels nor its examples. One task fits one model."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(sample(documents, doc_id, text, host))
    kinds = [None, "shapes", *_FAMILIES, *_LANGUAGES]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for kind in pdf["kind"]:
                model = train(shared.value, kind or None)
                if not kind:
                    yield pd.DataFrame(sorted(model.report.items()), columns=["measure", "value"])
                    continue
                z = model.scores(features_of_segments(examples(kind)))
                yield pd.DataFrame([(f"recall_left_out_{kind}", float((z > model.threshold).mean()))], columns=["measure", "value"])

    rows = spark.createDataFrame([(k or "",) for k in kinds], "kind string").repartition(len(kinds))
    return rows.mapInPandas(run, "measure string, value double")
