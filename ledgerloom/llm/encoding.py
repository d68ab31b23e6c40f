"""Text garbled by reading bytes in the wrong encoding: found, and restored where that is possible.

A multinomial classifier on hashed bigrams of UTF-8 bytes is trained on words garbled synthetically through each chain of
encodings, also twice or put in capitals afterwards, and predicts the exact chain of a suspicious word. The chain is then
inverted: a word counts as damaged only if the classifier holds the chain for more likely than none and the inverse is strictly
decodable to characters in use. Damage that lost bytes (replacement characters, question marks
inside words) is found but can't be restored.

Words are classified on their own, so damage in places is found too. Built-in expressions leave out all records without a
suspicious character before anything reaches Python.

Defined results: null and empty texts are undamaged. A word that no chain explains stays as it is. Rows without id are
left out; repeated rows give repeated results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (encoding the bytes were in, encoding they were read as).
CHAINS: tuple[tuple[str, str], ...] = (
    ("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac-roman"), ("utf-8", "cp1251"),
    ("cp1252", "cp1251"), ("cp1252", "mac-roman"),
)
#: Chains gone through twice, as classes of their own.
TWICE: tuple[tuple[tuple[str, str], ...], ...] = tuple((a, b) for a in CHAINS[:2] for b in CHAINS[:2])
CLEAN, LOST = "clean", "lost"
DIMS = 8192
#: Words of the languages at hand and symbols, from which garbled ones are made.
SEEDS = """été créditée réception délai dépôt société chèque prêt téléchargé à l’agence échéance impayée greffe n’a où ça reçu pièces août
février intérêts supplémentaires prélevés côté forêt naïf Noël cœur œuvre maître hôtel être même déjà élève français garçon établissement
désormais acceptée exécuté l’ordre N’êtes n’êtes l’origine opération prévenez-nous immédiatement D’une reportée ultérieure fixée où
für über zusätzliche Gebühren März nächste mündliche Überweisung Öffnungszeiten während Rückfragen geprüft zuständigen zurückgegeben
verspäteter fällt Jahresabschluss veröffentlicht Straße groß müssen können schön Ärger Übung Größe spätestens gehören Vermögen Lösung
Café Brûlé Genève Zürich São résumé señor mañana niño años vidéo piñata façade
“note” ‘note’ it’s don’t beneficiary’s appellant’s Mehul’s “so” – — … • €5 £20 ₹1,200 ₹ € £ § ½ 7½ ¼ № ° ± µm © ® ™ “the “key” “desk.” “was”
खाते में न्यूनतम शेष राशि बनाए रखना आवश्यक है। कृपया तक अपने दस्तावेज़ शाखा में जमा करें। करदाता को नोटिस का उत्तर दिनों के भीतर देना होगा।
आम्ही तुमची तक्रार नोंदवली आहे. न्यायालयाने पुढील सुनावणी रोजी ठेवली तपाईंको खातामा रकम जम्मा गरिएको छ। ऋणको किस्ता समयमा झाली बँक
શાખા રવિવારે બંધ રહેશે. બેંકે તમારી અરજી મંજૂર કરી છે. તમે આપેલો ચેક ચુકવણી વિના પાછો આવ્યો લોનનો હપ્તો સમયસર ન ભરવાથી
வங்கி உங்கள் விண்ணப்பத்தை ஏற்றுக்கொண்டது. கடன் தவணையை நேரத்தில் செலுத்தாவிட்டால் கூடுதல் வட்டி விதிக்கப்படும். கிளை மாத
বাংলা ব্যাংক ਪੰਜਾਬੀ ਬੈਂਕ తెలుగు బ్యాంకు ಕನ್ನಡ ಬ್ಯಾಂಕ್ മലയാളം ബാങ്ക്"""
#: Proper words that look unusual: capitals, other scripts, box drawing, signs.
PROPER = """ÀÉÎÕÜ RELEVÉ CLÔTURÉ GÂTEAU D’ÂGE DÉPÔT REÇU CHÂLET-L’ÎLE SÃO Â/c ÉTÉ ÊTRE À L’ORIGINE ÇA OÙ ÜBER FÜR ÄNDERUNG ÖFFNUNG GROẞ
Écrivez État École Été Église Également À Âge Île Ça Öffnungszeiten Überweisung Ärzte Übrigens Über Äpfel Ödem Österreich
БАНК № банк России документ счёт Москва Привет ΜΜ Ω Αθήνα τράπεζα λόγος ╔══ ══╗ ║ ╚══╝ ═══ ├── └── │ ─── ░▒▓ → ← ✓ Ø Ø40 µm ± ©
Zürich–Genève £20 ½ ¿Qué ¡Hola año Ñandú smørrebrød Århus Łódź Kraków Dvořák Čapek őr naïve coöperate «note» ‹note› 中文 日本語 한국"""


def _bytes(text: str, encoding: str) -> bytes | None:
    """``text`` in ``encoding``; C1 controls stand for bytes the encoding leaves undefined."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        pass
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(encoding)
        except UnicodeEncodeError:
            if 0x80 <= ord(ch) < 0xA0 and encoding in ("cp1252", "cp1251"):
                out.append(ord(ch))
            else:
                return None
    return bytes(out)


def _read(raw: bytes, encoding: str) -> str:
    """``raw`` read as ``encoding``; bytes it leaves undefined become C1 controls."""
    if encoding in ("cp1252", "cp1251"):
        return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in raw)
    return raw.decode(encoding)


def garble(text: str, chain: tuple[str, str]) -> str | None:
    """``text`` as it looks when its bytes are read wrongly; None where that can't be."""
    raw = _bytes(text, chain[0])
    return None if raw is None else _read(raw, chain[1])


def _in_use(ch: str) -> bool:
    o = ord(ch)
    return o < 0x80 and o >= 0x20 or 0xA0 <= o < 0x300 or 0x370 <= o < 0x530 or 0x900 <= o < 0xE00 or 0x2010 <= o < 0x2070 or 0x20A0 <= o < 0x2300 or 0x2500 <= o < 0x2600 or o in (0x200C, 0x200D)


def invert(word: str, chain: tuple[str, str]) -> str | None:
    """What ``word`` was before ``chain``, if that is strictly decodable to other characters in use; else None."""
    raw = _bytes(word, chain[1])
    if raw is None:
        return None
    try:
        out = raw.decode("utf-8") if chain[0] == "utf-8" else _read(raw, chain[0])
    except UnicodeDecodeError:
        return None
    if out == word or not all(map(_in_use, out)) and not any(map(_suspicious, out)):
        return None
    return out


def _suspicious(ch: str) -> bool:
    return 0x80 <= ord(ch) < 0xA0


def unshout(word: str, chain: tuple[str, str]) -> str | None:
    """The inverse of a garbled word that was put in capitals afterwards: each letter may have been a small one."""
    options = []
    for ch in word:
        small = "µ" if ch == "Μ" else ch.lower()
        raw = {b for c in (ch, small) if (b := _bytes(c, chain[1])) and len(b) == 1}
        if not raw:
            return None
        options.append(raw)
    out, i = bytearray(), 0
    while i < len(options):
        for raw in sorted(options[i], reverse=True):
            b = raw[0]
            size = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
            tail = [min((x for x in o if 0x80 <= x[0] < 0xC0), default=None) for o in options[i + 1 : i + size]]
            if size and len(tail) == size - 1 and None not in tail:
                out += raw + b"".join(tail)
                i += size
                break
        else:
            return None
    try:
        text = bytes(out).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if len(text) < len(word) and all(map(_in_use, text)) else None


def _features(word: str) -> np.ndarray:
    """Hashed bigrams of bytes, of which one at least is no ASCII: how common the letters around are tells nothing."""
    raw = b"\x02" + word.encode("utf-8", "surrogatepass") + b"\x03"
    return np.array([(a * 257 + b * 31) % DIMS for a, b in zip(raw, raw[1:]) if a > 0x7F or b > 0x7F], np.int64)


@dataclass
class Classifier:
    """Multinomial over hashed byte bigrams."""

    classes: list
    weights: np.ndarray

    def ranked(self, word: str) -> list[tuple[float, object]]:
        """(log odds against clean, class), most likely first."""
        score = self.weights[:, _features(word)].sum(axis=1)
        score -= score[0]
        return sorted(zip(score.tolist(), self.classes), key=lambda x: -x[0])


@lru_cache(maxsize=1)
def train(smoothing: float = 0.05) -> Classifier:
    """Trained on ``SEEDS`` garbled through each chain against the same words and ``PROPER`` as they are. The same each time."""
    words = list(dict.fromkeys(SEEDS.split()))
    words += [w.strip("“”‘’.,।") for w in words]
    words = [w for w in dict.fromkeys(words) if w]
    proper = PROPER.split()
    classes: list = [CLEAN, *((c,) for c in CHAINS), *TWICE]
    counts = np.full((len(classes), DIMS), smoothing)
    for w in words + proper:
        np.add.at(counts[0], _features(w), 1)
    for k, steps in enumerate(classes[1:], 1):
        for w in words:
            g = w
            for step in steps:
                g = g and garble(g, step)
            if g and g != w:
                np.add.at(counts[k], _features(g), 1)
                if steps[0][0] == "utf-8" and g.upper() != g:
                    np.add.at(counts[k], _features(g.upper()), 0.2)
    return Classifier(classes, np.log(counts / counts.sum(axis=1, keepdims=True)))


_LOST_IN_WORD = re.compile(r"[^\W\d_]\?[^\W\d_]")
_WORD = re.compile(r"[^ \n\t\r]*[^\x00-\x7f][^ \n\t\r]*|[^ \n\t\r]*[^\W\d_]\?[^\W\d_][^ \n\t\r]*")
#: Question marks where characters were lost: before a word or a number, four and more, or one word of them after another.
_LOST_RUN = re.compile(r"(?:^|\s)\?(?:[^\W\d_]+(?![^\s.,;:?])|\d)|\?{4,}|(?:^|\s)\?{2,}[.,]?\s+\?{2,}(?=[.,\s]|$)")
#: Nothing but proper Indic text, ASCII, common punctuation and currency signs.
_PLAIN = re.compile("[\x20-\x7eऀ-෿“”‘’–—…₹€£‌‍]*")


class Detector:
    """Verdicts on words, remembered."""

    def __init__(self, keep: int = 200_000) -> None:
        self.model, self.known, self.keep = train(), {}, keep

    def word(self, w: str) -> tuple[object, str | None]:
        """(chain, 'lost' or 'clean'; the word restored)."""
        got = self.known.get(w)
        if got is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            got = self.known[w] = self._judge(w)
        return got

    def _judge(self, w: str) -> tuple[object, str | None]:
        if "�" in w or _LOST_IN_WORD.search(w) and not re.search(r"[/=&]", w):
            return LOST, None
        if _PLAIN.fullmatch(w):
            return CLEAN, w
        ranked = [(odds, steps) for odds, steps in self.model.ranked(w) if steps != CLEAN and odds > 0]
        # of the chains that are likelier than none, those that strict decoding can prove come first
        for odds, steps in sorted(ranked, key=lambda x: x[1][0][0] != "utf-8"):
            multi = steps[0][0] == "utf-8"
            if not multi and odds < 4:
                continue
            out: str | None = w
            for step in reversed(steps):
                out = out and invert(out, step)
            if out is None and multi and len(steps) == 1 and w.upper() == w:
                out = unshout(w, steps[0])
            if out is None or not multi and not self._natural(w, out):
                continue
            again = self._judge(out)[1] if multi and not _PLAIN.fullmatch(out) else None
            return steps[0], again if again is not None else out
        return self._partly(w, [steps[0] for _, steps in ranked if len(steps) == 1 and steps[0][0] == "utf-8"])

    @staticmethod
    def _natural(before: str, after: str) -> bool:
        """For chains between single-byte encodings, which decode anything: the result is one Latin word in one case,
        which the word wasn't."""
        letters = [c for c in after if c.isalpha()]
        if not letters or any(ord(c) > 0x17F for c in letters):
            return False
        mixed = any(c.isascii() and c.isalpha() for c in before)
        body = "".join(letters)
        return mixed and len(body) > 2 - ("’" in after) and (body.islower() or body.isupper() or body[0].isupper() and body[1:].islower() or "’" in after)

    def _partly(self, w: str, chains: list[tuple[str, str]]) -> tuple[object, str | None]:
        """A garbled word that was cut: by one of the likely ``chains`` most, not all of it decodes."""
        for chain in chains:
            raw = _bytes(w, chain[1])
            if raw is None:
                continue
            text = raw.decode("utf-8", "replace")
            good = sum(ord(c) >= 0x900 and c != "�" for c in text)
            if good >= 2 and good > 2 * text.count("�") and all(_in_use(c) or c == "�" for c in text):
                return chain, None
        return CLEAN, w

    def text(self, text: str) -> tuple[list, str, bool]:
        """(chains found, the text restored, whether all damage could be restored)."""
        chains: dict = {}
        whole = True

        def restore(m: re.Match) -> str:
            nonlocal whole
            chain, out = self.word(m[0])
            if chain == CLEAN:
                return m[0]
            chains[chain] = None
            whole &= out is not None
            return m[0] if out is None else out

        out = _WORD.sub(restore, text)
        if "?" in text and LOST not in chains and _LOST_RUN.search(text):
            chains[LOST], whole = None, False
        return list(chains), out, whole


#: What a record must hold to be looked at: something outside plain text, or question marks in odd places.
SUSPICIOUS = r"[^\x00-\x7Fऀ-෿“”‘’–—…₹€£‌‍]|\p{L}\?\p{L}|(^|\s)\?[\p{L}\d]|\?{4}|(^|\s)\?{2,}[.,]?\s+\?\?"


def find_damage(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, chains, restored, restorable) of each record with damage."""
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(SUSPICIOUS))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector()
        for f in frames:
            out = []
            for i, t in zip(f["id"], f["text"]):
                chains, restored, whole = detector.text(t)
                if chains:
                    names = [c if isinstance(c, str) else f"{c[0]}>{c[1]}" for c in chains]
                    out.append((i, names, restored, whole))
            yield pd.DataFrame(out, columns=["id", "chains", "restored", "restorable"])

    return rows.mapInPandas(work, "id long, chains array<string>, restored string, restorable boolean")
