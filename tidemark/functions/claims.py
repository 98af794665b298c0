"""What a claim says of itself: topic, importance, hedging, entities, candidate score. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.words import WORD, bounded, words

# ---- fixed values: keyword alternatives, in order of precedence ------------------------------------------------------
NEGATION = r"no longer|never|not|isn't|are\s+n't|aren't|wasn't|weren't|doesn't|don't|didn't|quit|resigned|left|divorced|broke\s+up|stopped"
UPDATE_VERB = (
    r"joined|started\s+(at|working|a\s+new)|began\s+working|now\s+works|now\s+working|currently\s+works|currently\s+working|now\s+employed|"
    r"recently\s+(joined|started|hired)|accepted\s+(a|an)\s+(new\s+)?job|took\s+(a|an)\s+(new\s+)?job|got\s+(a|an)\s+(new\s+)?job|"
    r"is\s+now\s+(at|working|employed)|hired\s+(at|by|as)|promoted\s+(to|as)|switched\s+(to|companies)|changed\s+(to|companies|jobs?)|"
    r"transferred\s+to|moved\s+(to|into|back\s+to)|relocated\s+(to|from)|now\s+lives|living\s+(in|at)\s+(a\s+new|my\s+new)|got\s+married|"
    r"got\s+engaged|got\s+divorced|is\s+now\s+(married|engaged|single|dating)|started\s+dating|broke\s+up|separated\s+from|enrolled\s+in|"
    r"graduated\s+from|completed\s+(a|his|her|their)|is\s+now|now\s+is|recently\s+became|became\s+(a|an|the)"
)
LEFT_FOR = r"left\s+for\s+"
TEMPORAL = r"used\s+to|previously|formerly|back\s+when|at\s+that\s+time|in\s+the\s+past|until\s+recently|at\s+one\s+point"
HEDGE = (
    r"might|maybe|perhaps|possibly|probably|likely|unlikely|thinking\s+(about|of)|considering|may\s+(be|move|join|go|come|become)|"
    r"could\s+(be|become|move|join|go|happen)|hopes?\s+to|wants?\s+to|wishes\s+to|plans?\s+to|intends?\s+to|expecting\s+to|going\s+to|"
    r"about\s+to|if|unless|in\s+case"
)
HIGH = (
    r"works?\s+at|working\s+at|employed\s+by|hired|quit|resigned|fired|promoted|joined|started\s+(at|working)|career|new\s+job|got\s+a\s+job|"
    r"lives?\s+in|moved?\s+to|relocated|based\s+in|living\s+in|staying\s+in|new\s+home|moved\s+house|"
    r"married|divorced|engaged|separated|broke\s+up|spouse|husband|wife|boyfriend|girlfriend|fianc[eé]e?|wedding|"
    r"diagnosed|surgery|hospitali[sz]ed?|cancer|pregnant|pregnanc|died|death|passed\s+away|ill(ness)?|disease|treatment|recovering|"
    r"gave\s+birth|had\s+a\s+baby|accident|injury|graduated|graduation|degree|PhD|masters?|bachelors?|university|college|enrolled|"
    r"accepted\s+(to|into)|owns?\s+(a|an|the)|bought\s+(a|an|the)|purchased\s+(a|an|the)|sold\s+(a|an|the)|house|apartment|condo|car|vehicle"
)
MEDIUM = (
    r"likes?|loves?|enjoys?|hobby|hobbies|passionate\s+about|fan\s+of|interested\s+in|plans?\s+to|going\s+to|intends?\s+to|"
    r"scheduled\s+(to|for)|appointment|prefers?|preference|favorite|favourite|best\s+(part|thing|place)|grew\s+up|childhood|"
    r"originally\s+from|background|born\s+in|raised\s+in|hometown"
)
LOW = (
    r"thinks?|feels?\s+(that|like)|believes?|assumes?|guesses?|maybe|probably|perhaps|might|said\s+that|mentioned|"
    r"told\s+(me|him|her|us|them)|talked\s+about|discussed|asked\s+about"
)
TOPICS = {
    "employment": r"works?\s+(at|for|in|as)|worked\s+(at|for|in|as)|working\s+(at|for|in|as)|started\s+working|began\s+working|now\s+works?|"
    r"currently\s+works?|employed|hired|quit|resigned|fired|promoted|joined|job|career|company|startup|office|engineer|developer|scientist|"
    r"manager|analyst|designer|director|researcher|consultant|programmer|architect|lead|intern",
    "location": r"lives?\s+in|lived\s+in|living\s+in|resides?\s+in|residing\s+in|moved?\s+to|relocated|based\s+in|located\s+in|stays?\s+in|"
    r"staying\s+in|city|country|home|apartment|house|neighborhood|hometown",
    "relationships": r"married|divorced|engaged|separated|spouse|husband|wife|boyfriend|girlfriend|fianc[eé]e?|partner|family|wedding|dating|"
    r"broke\s+up|in\s+a\s+relationship|seeing\s+someone",
    "health": r"diagnosed|surgery|hospital|cancer|pregnant|died|death|ill(ness)?|disease|treatment|medicine|doctor|baby",
    "education": r"graduated|graduation|degree|school|university|college|studi(ed|es|ing)|student|enrolled|accepted\s+(to|into)|academic|"
    r"thesis|dissertation|course|class|campus|major|minor|doctorate|postgrad|undergrad|alumni|alumna",
    "ownership": r"owns?|bought|purchased|sold|house|car|vehicle|property",
    "opinion": r"thinks?|feels?|believes?|opinions?|prefers?|guesses?|maybe|probably",
    "plans": r"plans?\s+to|going\s+to|intends?\s+to|scheduled|appointment",
    "lifestyle": r"hobby|hobbies|interested?\s+in|likes?|loves?|enjoys?|food|travel|music|sport|exercise|fitness",
}
GENERAL = "general"
NOT_ENTITIES = (
    "The A An In On At By For To Of With From Into About Through During Before After Between Under And Or But So As If Then When While "
    "Although Because However Therefore Despite I You He She It We They Me Him Her Us Them My Your His Its Our Their This That These Those "
    "What Which Who Whose Whom Where How Why Is Are Was Were Has Have Had Do Does Did Be Been Being Will Would Could Should May Might User "
    "Person Someone Anyone Everyone Nobody People No Not Now Also Just Still Even Only Both All More Most Very Much Many"
).split()
TOPIC_MARKERS = (
    "work works worked working job jobs career company boss office promotion salary interview hired fired quit team colleague manager employee "
    "client project family spouse wife husband partner kid kids child children son daughter mother father mom dad sibling brother sister married "
    "divorce wedding engaged engagement fiance fiancee doctor hospital sick ill illness medication surgery diagnosis diagnosed appointment pain "
    "treatment medicine therapy recovery patient prescription symptom symptoms moved moving relocate apartment house city country trip travel "
    "vacation flight visit visited abroad school college university degree graduate graduated student class course exam yesterday today tomorrow "
    "tonight weekend monday tuesday wednesday thursday friday saturday sunday morning afternoon evening night january february march april may "
    "june july august september october november december"
).split()
ACTION_VERBS = (
    "is was are were has have had do does did been being went going came got gave took made make moved started stopped finished began told said "
    "asked answered called wrote read spoke talked mentioned explained decided chose picked joined left quit married divorced graduated hired "
    "fired promoted diagnosed recovered bought sold paid earned ate drank saw met visited stayed worked slept watched played"
).split()
OPINIONS = (
    "think thinks thought feel feels felt guess maybe perhaps probably possibly suppose wish hope wonder imagine seems seem seemed"
).split()
CAPITAL_STARTERS = (
    "I The A An But And So Then Now Yes No Oh Hey Well Maybe Yeah Yep Sure Okay Ok This That These Those It We You He She They My Your His Her "
    "Their Our When Where What Why How Who Which Do Did Have Has Is Are Was Were"
).split()
QUESTION_STARTERS = [
    "do you", "did you", "does ", "are you", "is it", "have you", "could you", "would you", "should ", "can you", "what do", "what is",
    "what are", "what was", "what were", "how do", "how is", "how was", "how are", "where do", "where is", "where are", "where was", "when do",
    "when is", "when was", "when did", "why do", "why is", "why are", "why was", "who is", "who are", "who was", "who did",
]
NUMBER_OR_DATE = (
    r"\d{4}|\d+(st|nd|rd|th)|\d{1,2}[:/-]\d{1,2}([:/-]\d{2,4})?|\d+\s*(years?|months?|weeks?|days?|hours?|minutes?|seconds?)|"
    r"\d+\s*(dollars?|miles?|km|kg|lbs?|pounds?|hours?)|\d{1,3}(,\d{3})+(\.\d+)?"
)
WEIGHTS = {"entity": 0.30, "verbs": 0.20, "factual": 0.15, "markers": 0.15, "length": 0.10, "number": 0.10}
CANDIDATE = 0.35
HEDGED, FROM_MODEL, FROM_RULES = 0.35, 0.9, 0.5
# ----------------------------------------------------------------------------------------------------------------------

NEGATION_RE, TEMPORAL_RE, HEDGE_RE = bounded(NEGATION), bounded(TEMPORAL), bounded(HEDGE)
# "left for" must be followed by a word, all others by a boundary
UPDATE_RE = rf"{bounded(UPDATE_VERB)}|(?iu)(?:^|[^{WORD}]){LEFT_FOR}[{WORD}]"
ENTITY_RE = r"(?<![.!?\n])\b([A-Z][a-z]{1,}(?:\s+[A-Z][a-z]{1,})*|[A-Z]{2,})\b"
NUMBER_RE = rf"{bounded(NUMBER_OR_DATE)}|\$\d+"


def has_negation(claim: Column) -> Column:
    return claim.rlike(NEGATION_RE)


def has_update_verb(claim: Column) -> Column:
    return claim.rlike(UPDATE_RE)


def is_temporal_claim(claim: Column) -> Column:
    return claim.rlike(TEMPORAL_RE)


def is_speculative(claim: Column) -> Column:
    """Hedged, planned or conditional, or a question."""
    return claim.rlike(HEDGE_RE) | claim.rlike(r"\?\s*$")


def topic(claim: Column) -> Column:
    """The first topic whose keywords occur; null and empty claims are general."""
    out = F.lit(GENERAL)
    for name, keywords in reversed(TOPICS.items()):
        out = F.when(claim.rlike(bounded(keywords)), name).otherwise(out)
    return out


def importance(claim: Column) -> Column:
    """0.85, 0.55 or 0.30 by the highest tier that matches, else 0.45."""
    return F.when(claim.rlike(bounded(HIGH)), 0.85).when(claim.rlike(bounded(MEDIUM)), 0.55).when(claim.rlike(bounded(LOW)), 0.30).otherwise(0.45)


def entities(claim: Column) -> Column:
    """Runs of title-case words, or capitals, in order of appearance; none after a full stop without space."""
    found = F.regexp_extract_all(claim, F.lit(ENTITY_RE), F.lit(1))
    return F.coalesce(F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(NOT_ENTITIES))), F.array().cast("array<string>"))


def claim_confidence(claim: Column, base: float = FROM_RULES) -> Column:
    """``base``, lowered to 0.35 for speculative claims."""
    return F.when(is_speculative(claim), F.least(F.lit(base), F.lit(HEDGED))).otherwise(F.lit(base))


def _share_of(hits: Column, full: float) -> Column:
    return F.least(F.lit(1.0), hits / F.lit(full))


def candidate_scores(text: Column, weights: dict[str, float] | None = None, threshold: float = CANDIDATE) -> dict[str, Column]:
    """The six sub-scores, ``score`` and ``is_candidate`` of a text; null counts as empty."""
    w = weights or WEIGHTS
    if abs(sum(w.values()) - 1) > 1e-3:
        raise ValueError("weights must add up to 1")
    text = F.coalesce(text, F.lit(""))
    # runs of ASCII letters that stand alone among word characters
    spelt = F.filter(F.regexp_extract_all(text, F.lit(rf"[{WORD}]+"), F.lit(0)), lambda x: x.rlike("^[a-zA-Z]+$"))
    n = F.size(spelt)
    low = F.transform(spelt, F.lower)
    capital = F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-zA-Z'-]+\b"), F.lit(0))
    stripped = F.trim(text)
    lowered = F.lower(stripped)
    opinions = F.size(F.filter(words(lowered), lambda x: F.regexp_replace(x, r"^[.,!]+|[.,!]+$", "").isin(OPINIONS)))
    starts = F.lit(False)
    for s in QUESTION_STARTERS:
        starts = starts | lowered.startswith(s)
    out = {
        "entity": _share_of(F.size(F.filter(capital, lambda x: ~x.isin(CAPITAL_STARTERS))), 3.0),
        "verbs": F.when(n > 0, F.least(F.lit(1.0), F.size(F.filter(low, lambda x: x.isin(ACTION_VERBS))) / n * 8.0)).otherwise(0.0),
        "factual": F.when((stripped == "") | stripped.endswith("?") | starts, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - opinions * 0.3)),
        "markers": _share_of(F.size(F.filter(low, lambda x: x.isin(TOPIC_MARKERS))), 2.0),
        "length": F.when(n < 5, 0.0).when(n < 30, n / 30.0).when(n <= 150, 1.0).when(n <= 300, 1.0 - (n - 150) / 150.0).otherwise(0.0),
        "number": F.when(text.rlike(NUMBER_RE), 1.0).otherwise(0.0),
    }
    total = sum((w[k] * out[k] for k in w), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    return out | {"score": score, "is_candidate": score >= threshold}
