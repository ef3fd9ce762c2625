"""Language of a text from its scripts and function words."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

# Frequent function words by language; hi-latn is Hindi in Latin letters.
FUNCTION_WORDS = {
    "en": "a an the of to in and or for on at by with from as is are be been was were has have had not no this that these those it its if when where which who will may can must shall should after before under any all one two into than then each every only over once within until unless while you your we our their they i my me what how why do does did there".split(),
    "es": "el la los las un una de del al y o que en por para con sin se es son está desde hasta su sus lo le no ningún cuando como más si este esta cada durante plazo cuenta días usted qué cuánto puedo".split(),
    "fr": "le la les un une des du de et ou que qui en par pour avec sans se est sont au aux dans sur son sa ses ce cette ne pas plus si chaque jusqu depuis sous après aucune aucun votre vous je nous il elle".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder in im am an auf für mit ohne von vom zu zum zur ist sind wird werden nach bis bei nicht kein keine wenn als auch pro innerhalb ihr ihre sie wir es".split(),
    "pt": "o os as um uma de do da dos das e ou que em no na nos por para com sem se é são até seu sua não mais quando cada".split(),
    "it": "il lo gli un una di del della dei e o che in nel nella per con senza si è sono da dal fino non più ogni quando".split(),
    "hi-latn": "ka ki ke ko mein se par hai hain aur ya kya kyun kab kaise mera meri mere aapka aapke aapko aap hum nahi nahin karna karne ho hoga jayega jaye tak liye din wapas yeh woh ek bhi agar to andar saath baje hota lagta lagte laye laayein jama kitne kripya".split(),
    "hi": "का की के को में से पर है हैं और या क्या क्यों कब कैसे मेरा मेरी मेरे आपका आप हम नहीं करना करने हो होगा जाएगा जाएगी तक लिए यह वह एक भी यदि तो साथ इस दी दिन भीतर".split(),
    "ar": "في من إلى على عن أن هذا هذه التي الذي مع أو و لا ما هل كل بعد قبل خلال يجب حتى منذ".split(),
}
#: Share of a text's words that must be function words of a language to name it.
LEAST_SHARE = 0.12
#: Different function words that a longer text must have.
LEAST_WORDS = 3
_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
_LATIN = ("en", "es", "fr", "de", "pt", "it", "hi-latn")

_DEVANAGARI = re.compile("[ऀ-ॿ]+")
_ARABIC = re.compile("[؀-ۿݐ-ݿ]+")
_OTHER = re.compile("[Ͱ-ӿԱ-֏֐-׿ঀ-෿ก-๿ༀ-࿿ა-ჿ぀-ヿ㐀-鿿가-힯]+")
_LATIN_WORD = re.compile(r"[a-zà-öø-ÿœß]+")


@lru_cache(100_000)
def _languages_of(word: str) -> tuple[str, ...]:
    return tuple(k for k in _LATIN if word in _SETS[k])


def language(text: str, prefer: str | None = None, counts: dict[str, int] | None = None) -> tuple[str, float]:
    """(language, share of its function words among the words). Texts without evidence get ``prefer`` or "und".

    ``counts``: how often each lower-case word occurs, where the caller has that already.
    """
    low = text if counts is not None else text.lower()
    if not low.isascii():
        native = sum(map(len, _DEVANAGARI.findall(low)))
        arabic = sum(map(len, _ARABIC.findall(low)))
        if native or arabic:
            latin = sum(map(len, _LATIN_WORD.findall(low)))
            if native * 1.5 >= latin and native > 0 or arabic * 1.5 >= latin and arabic > 0:
                code = "hi" if native >= arabic else "ar"
                words = low.split()
                known = _SETS[code]
                return code, sum(w.strip("।.,?؟!،") in known for w in words) / max(1, len(words))
        other = sum(map(len, _OTHER.findall(low)))
        if other and other > sum(map(len, _LATIN_WORD.findall(low))):
            return "other", 0.0
    if counts is None:
        counts = Counter(_LATIN_WORD.findall(low))
    total = sum(counts.values())
    seen: dict[str, list[int]] = {k: [0, 0] for k in _LATIN}
    for w, n in counts.items():
        for k in _languages_of(w):
            seen[k][0] += n
            seen[k][1] += 1
    best = max(_LATIN, key=lambda k: seen[k][0])
    if not total or seen[best][0] < LEAST_SHARE * total or total > 20 and seen[best][1] < LEAST_WORDS:
        return prefer or "und", 0.0
    return best, seen[best][0] / total
