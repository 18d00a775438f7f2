"""The rule catalogue: phrase rules, lexicon and rewrites, as data in a small template language.

A template is text with these marks:

``{a b c}``  one of the words; ``_`` in a word stands for a space
``[a b]``    one of the words and a space, or nothing
``~``        an optional s
``<1,80>``   as few characters as possible, 1 to 80, none of which ends a sentence
``@``        a word of any letters

Both ends of a template are word boundaries unless it starts or ends with ``%``. ``re:`` starts a plain regular
expression. Each compiled rule knows a set of lower-case literals of which every match holds one, so that a
scan can skip the expression on almost every text with a byte search.
"""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass
from pathlib import Path

SEVERITIES = {"low": 1, "medium": 2, "high": 4}
RANKS = {"low": 1, "medium": 2, "high": 3}
_L, _M, _H = "low", "medium", "high"


@dataclass(frozen=True)
class Rule:
    """A named expression; regex is common to Java and RE2 unless look_around is set."""

    rule_id: str
    dimension: str
    severity: str
    regex: str
    anchors: tuple[str, ...]
    explanation: str = ""

    @property
    def java(self) -> str:
        """The expression for Spark: any case, ^ at each line, Unicode classes."""
        return f"(?imU){self.regex}"

    @property
    def look_around(self) -> bool:
        return "(?!" in self.regex or "(?<" in self.regex


_TOKEN = re.compile(r"\{([^}]*)\}|\[([^\]]*)\]|<(\d+),(\d+)>|([^{\[<]+)")


def _escape(words: str) -> str:
    return re.sub(r"([.?*+()|])", r"\\\1", words.replace("_", " ")).replace("~", "s?").replace("@", r"\w+")


def compile_template(template: str) -> tuple[str, tuple[str, ...]]:
    """The expression and the literals of which each match holds at least one (none known: empty)."""
    if template.startswith("re:"):
        regex, _, anchors = template[3:].partition(" ## ")
        return regex, tuple(anchors.split("&")) if anchors else ()
    body, out = template.strip("%"), []
    best: tuple[tuple[int, int], tuple[str, ...]] | None = None
    for m in _TOKEN.finditer(body):
        one_of, optional, low, high, text = m.groups()
        if one_of is not None:
            words = one_of.split(" ")
            out.append(f"(?:{'|'.join(map(_escape, words))})")
            literals = tuple(w.replace("_", " ").split("~")[0].split("@")[0] for w in words)
        elif optional is not None:
            out.append(f"(?:(?:{'|'.join(map(_escape, optional.split(' ')))}) )?")
            continue
        elif low is not None:
            out.append(f"[^.?!]{{{low},{high}}}?")
            continue
        else:
            out.append(_escape(text))
            literals = (max(re.split("[~@]", text), key=len),)
        shortest = min(map(len, literals))
        if shortest >= 3:
            score = (-len(literals), shortest)
            if best is None or score > best[0]:
                best = (score, tuple(x.lower() for x in literals))
    start, end = ("" if template.startswith("%") else r"\b"), ("" if template.endswith("%") else r"\b")
    return start + "".join(out) + end, best[1] if best else ()


#: Dimension, prefix of the rule ids, and (name, severity, template, why) in scan order.
_PACKS: list[tuple[str, str, list[tuple[str, str, str, str]]]] = [
    (
        "formulaic_structure",
        "FORMULAIC_",
        [
            ("OPENING_FASTPACED", _M, "%in today's {digital fast-paced fast_paced rapidly_changing rapidly_evolving} {age era landscape world}%", "stock opening about the times"),
            ("WHETHER_BEGINNER", _M, r"re:whether you(?: are|'re) a (?:complete |seasoned)?\w+ or (?:an |a )?\w+ ## whether you", "stock address to all readers"),
            ("MORE_THAN_JUST", _M, "is [much]more than just", "inflated comparison"),
            ("NOT_ONLY_BUT_ALSO", _L, "re:\\bnot only\\b[^.?!]{1,80}?\\bbut (?:it )?also\\b ## not only", "paired emphasis"),
            ("AT_ITS_CORE", _L, "at its core", "filler framing"),
            ("COMPREHENSIVE_GUIDE", _M, "%in this [complete comprehensive ultimate]{article blog guide post}%", "announces the text instead of starting it"),
            ("LETS_DELVE", _H, "%let{_us 's} {delve dive explore take_a_look take_a_closer_look} {into in}", "invitation in place of content"),
            ("FROM_TO_OFFERS", _L, r"re:\bfrom \w+ to \w+,[^.?!]{1,60}?\boffers\b ## offers", "false range"),
            ("WHEN_IT_COMES_TO", _L, "when it comes to", "filler framing"),
            ("IN_CONCLUSION", _L, "in conclusion", "announced ending"),
            ("GAME_CHANGER", _M, "{game-changer game_changer game-changing game_changing}", "hype"),
            ("EVER_EVOLVING", _L, "{ever-evolving ever_evolving ever-changing ever_changing ever-growing ever_growing}", "hype"),
            ("RHETORICAL_WHAT_MEAN", _M, r"re:\b(?:but |so )?what does (?:it|that|this) mean\? ## what does", "question asked in order to answer it"),
            ("RHETORICAL_WHY_MATTER", _M, r"re:\bwhy (?:is (?:it|that|this) important|does (?:it|that|this) matter)\? ## matter?&important?", "question asked in order to answer it"),
            ("RHETORICAL_THE_ANSWER", _L, "the answer {may_surprise_you is_no is_simple is_yes}", "delayed answer"),
            ("RHETORICAL_HERES", _L, r"re:\bhere(?: is|'s) (?:how|the kicker|the thing|what|why)\b[:,] ## here's&here is", "announcement in place of the point"),
            ("RHETORICAL_SOUND_FAMILIAR", _M, r"re:\bsounds? familiar\? ## familiar?", "question asked for effect"),
            ("RHETORICAL_WHAT_IF", _L, "what if {we I} told you", "question asked for effect"),
        ],
    ),
    (
        "significance_inflation",
        "SIGNIF_",
        [
            ("STANDS_AS_TESTAMENT", _H, "{serves stands} as a {beacon cornerstone hallmark reminder symbol testament}", "inflated symbol"),
            ("PIVOTAL_ROLE", _M, "{playing played plays play} [an a]{central crucial important key pivotal significant vital} role", "inflated role"),
            ("MARKS_MOMENT", _M, "{marked marking marks represented represents represent} [a]{important key major pivotal significant turning} {chapter milestone moment point shift}", "inflated moment"),
            ("BROADER_MOVEMENT", _M, "[are is was were]part of a {broader growing larger wider} {context effort initiative movement shift trend}", "vague larger trend"),
            ("REFLECTS_BROADER", _M, "{embodies embodying highlights highlight reflecting reflects reflect symbolizes symbolizing underscores underscore} [its the]{broader enduring growing lasting ongoing wider} {appeal impact importance legacy significance trend}", "vague larger meaning"),
            ("INDELIBLE_MARK", _H, "{leaving left made making} [an its]{enduring indelible lasting profound} {impact impression legacy mark}", "inflated legacy"),
            ("DEEPLY_ROOTED", _L, "{deeply_embedded deeply_rooted firmly_rooted} in", "stock depth"),
            ("RICH_HERITAGE", _M, "{diverse rich storied vibrant} [cultural]{heritage history legacy tapestry tradition}", "travel-brochure praise"),
            ("CONTRIBUTING_BROADER", _L, "{contributed contributes contributing} to [the]{broader larger overall wider} {context development history narrative understanding}", "vague contribution"),
            ("SETTING_STAGE", _L, "setting the {foundation groundwork scene stage} for", "vague preparation"),
        ],
    ),
    (
        "weasel_attribution",
        "",
        [
            ("OVERATTR_FEATURED_IN", _M, r"re:\b(?:cited|covered|featured|mentioned|profiled) in\b[^.?!]{0,80}?\band (?:numerous|other|prominent|several|various) (?:(?:media|news|prominent) )?(?:outlet|platform|publication|source)s?\b ## outlet&platform&publication&source", "coverage listed as proof"),
            ("OVERATTR_INDEPENDENT_COVERAGE", _M, "{in-depth independent reliable significant substantial widely-read} [and][independent reliable significant substantial][secondary]coverage", "coverage asserted as proof"),
            ("OVERATTR_SOCIAL_PRESENCE", _H, "maintain~ [an a][active notable robust significant strong]{digital instagram online social_media twitter} presence", "presence as a fact"),
            ("OVERATTR_TRADE_PUBLICATIONS", _L, r"re:\b(?:industry|local|national|regional|trade) (?:media outlets?|press coverage|publications?)\b[^.?!]{0,40}?\b(?:including|like|such as)\b ## media outlet&press coverage&publication", "sources listed in general"),
            ("WEASEL_EXPERTS_ARGUE", _M, "{analyst~ commentator~ critic~ expert~ observer~ researcher~ scholar~} {argue believe contend have_argued have_cited have_noted note point_out say suggest}", "unnamed experts"),
            ("WEASEL_STUDIES_SHOW", _M, "{data evidence report~ research source~ studies survey~} {demonstrate~ find~ indicate~ reveal~ show~ suggest~}", "unnamed studies"),
            ("WEASEL_WIDELY", _L, "{broadly commonly generally universally widely} {acknowledged believed considered known recognized regarded seen viewed} {to_be as}", "opinion of nobody in particular"),
            ("WEASEL_INDUSTRY_REPORTS", _M, "{industry market media trade} {insider~ observer~ outlet~ publication~ report~}", "unnamed sources"),
            ("WEASEL_SOME_MANY", _L, "{many numerous several some various} {commentators critics experts observers reviewers scholars sources} [have]{argued argue believe claim feel noted note suggest}", "unnumbered holders of an opinion"),
        ],
    ),
    (
        "unsupported_claims",
        "CLAIM_",
        [
            ("EVERYONE_KNOWS", _M, r"re:\b(?:all people|everyone|nobody|no one|society|the (?:people|public|world)) (?:agrees|believes|knows|realizes|recognizes|understands) (?:that )?\b ## agrees &believes &knows &realizes &recognizes &understands ", "claim about everybody"),
            ("AUTHORITY_NO_CITATION", _M, r"re:\b(?:data|evidence|research|science|studies) (?:confirm|demonstrate|prove|reveal|show)s? (?:that )?(?![^.?!]{0,80}?(?:et al|https?://|\(\d{4}|\[)) ## data &evidence &research &science &studies ", "authority without a source"),
            ("REVOLUTIONIZED", _M, r"re:\b(?:(?:had|has|have) )?(?:completely (?:altered|changed)|fundamentally changed|reimagined|reshaped|revolutioniz(?:es|ed)|transformed|upended) (?:the )?(?:economy|field|industry|landscape|society|way people\b|way we\b|world)\b ## altered&changed&reimagined&reshaped&revolutioniz&transformed&upended", "sweeping change"),
            ("FUTURE_INEVITABLE", _L, r"re:\bthe (?:next (?:age|chapter|era|frontier|generation)|future) of [^.?!]{1,40}? (?:will be|is) (?:bright|here|inevitable|limitless|now|revolutionary|transformative|unprecedented)\b ## the next &the future of ", "certain future"),
            ("INCREASINGLY_WORLD", _L, "in {a an today's} {AI-powered AI_powered digitall-driven digitall_driven digitally-driven digitally_driven ever-changing ever_changing fast-paced fast_paced hyper-connected hyper_connected increasingly interconnected rapidly_changing rapidly_evolving} [digital global modern]{age economy environment era landscape society world}", "stock state of the world"),
            ("MORE_THAN_EVER", _L, "more {critical crucial essential important relevant vital} than ever{_before }", "comparison with all time"),
        ],
    ),
    (
        "prompt_residue",
        "RESIDUE_",
        [
            ("AS_AN_AI", _H, r"re:\bas an? (?:large |ai)?(?:language )?(?:ai|model)\b ## as a", "assistant speaking of itself"),
            ("CANNOT_BROWSE", _H, "I {am_unable_to can't cannot} {access browse} [the]internet", "assistant refusing"),
            ("REVISED_VERSION", _H, "here{_is 's} [a the]{improved revised rewritten updated} version", "assistant handing over"),
            ("CERTAINLY", _M, r"re:^\s*(?:absolutely|certainly|of course|sure)[,.!] ## absolutely&certainly&of course&sure", "assistant agreeing"),
            ("LET_ME_KNOW", _M, "let me know if {there_is_anything there's_anything you_need you_would_like you'd_like}", "assistant closing"),
            ("HOPE_THIS_HELPS", _M, "I hope this helps", "assistant closing"),
            ("PLACEHOLDER", _H, r"re:\[(?:citation needed|insert[^\]]*|placeholder|your \w+ here)\] ## [", "placeholder left in"),
            ("CODE_FENCE", _M, "re:```(?:html|json|markdown|text)? ## ```", "fence left in"),
            ("KNOWLEDGE_CUTOFF", _H, r"re:\b(?:my )?(?:training|knowledge) (?:data|cut[- ]?off) (?:extends|goes up to|is)\b ## training &knowledge ", "assistant speaking of its data"),
        ],
    ),
    (
        "parallelism",
        "PARALLEL_",
        [
            ("NOT_ONLY_BUT_ALSO", _L, r"re:\bnot only\b[^.?!]{1,80}?\bbut (?:(?:also|it|they) )?(?:also )?\b ## not only", "paired emphasis"),
            ("ITS_NOT_ITS", _M, "re:\\bit(?: is| was|'s)\\s+not\\s+(?:just\\s+)?[^.?!,;]{1,60}[,;—-]+\\s*it(?: is| was|'s)\\b ## not", "denial and correction"),
            ("NOT_JUST", _M, "re:\\b(?:are|is|was|were)\\s+not\\s+just\\b[^.?!]{1,60}?[,;—-]\\s*(?:they(?: are|'re)|it(?: is|'s))\\b ## just", "denial and correction"),
            ("NOT_X_BUT_Y", _L, r"re:\bis not (?:(?:an|a|the) )?[^.?!,;]{1,40} but (?:(?:an|a|rather) )\b ## is not ", "denial and correction"),
            ("NO_NO_JUST", _M, r"re:\bno\s+\w+[^.?!]{1,40}?,\s*no\s+\w+[^.?!]{1,40}?,\s*(?:only|just)\b ## only&just", "list of denials"),
            ("RATHER_THAN_PRIORITIZE", _L, r"re:\b(?:chose|emphasiz(?:ing|es)|focus(?:ing|es) on|prioritiz(?:ing|es))\b[^.?!]{1,60}?\brather than\b ## rather than", "stock contrast"),
            ("X_NOT_Y", _L, r"re:(?:(?<=\*\*)|(?<=[.!?:]\s)|^)[A-Z][^.?!,;:]{1,30},\s+not\s+[^.?!,;:]{1,30}[.!?] ## not", "slogan"),
        ],
    ),
    (
        "copula_avoidance",
        "COPULA_",
        [
            ("SERVES_AS", _L, r"re:\b(?:acted|acts?|functions?|operates?|served|serves?|serving|stands?|stood) as (?:(?:an|the|a) )\b ##  as a& as the ", "dressed-up is"),
            ("REPRESENTS", _L, r"re:\b(?:constitutes?|embodies|exemplifies|represented|represents?) (?:(?:an|the|a) )\b ## constitute&embodies&exemplifies&represent", "dressed-up is"),
            ("BOASTS", _M, r"re:\bboasts? (?:(?:an|a|its|more than|over|the) )?\b ## boast", "dressed-up has"),
            ("FEATURES_OFFERS", _L, r"re:\b(?:delivers?|features?|offers?|provides?|showcases?) (?:(?:an|a|its|the) )(?:(?:comprehensive|diverse|stunning|vast|wide) )?\b ## deliver&feature&offer&provide&showcase", "dressed-up has"),
        ],
    ),
]


def _build() -> list[Rule]:
    out = []
    for dimension, prefix, rules in _PACKS:
        for name, severity, template, why in rules:
            regex, anchors = compile_template(template)
            out.append(Rule(prefix + name, dimension, severity, regex, anchors, why))
    return out


RULES: list[Rule] = _build()

#: Category: weight, severity, factors by profile, words (``delve+s+ing`` is delve, delves, delving).
_LEXICON: dict[str, tuple[float, str, dict[str, float], str]] = {
    "abstract_nouns": (0.8, _L, {"academic": 0.6, "technical": 0.6}, "cornerstone ecosystem landscape paradigm realm synergy testament"),
    "generic_importance": (0.8, _L, {"academic": 0.4, "technical": 0.3}, "comprehensive crucial essential integral key notable paramount pivotal robust significant transformative valuable vital"),
    "marketing_uplift": (1.0, _M, {"marketing": 0.4}, "empower+s+ing revolutionize+s+d supercharge unleash+es unlock+s+ing"),
    "overpolished_verbs": (1.0, _M, {"academic": 0.6, "technical": 0.5, "marketing": 0.7}, "bolster+ed+ing delve+s+ing+d elevate+s+ing foster+ing garner+s+ing harness+ing illuminate+ing leverage+s+ing navigate+ing showcase+s+ing streamline+ing underscore+s+ing"),
    "synthetic_sophistication": (1.0, _M, {"academic": 0.5, "technical": 0.5}, "dynamic enduring holistic interplay intricacies intricate meticulous meticulously multifaceted nuanced seamless tapestry vibrant"),
    "template_transitions": (0.7, _L, {"academic": 0.5, "essay": 0.6}, "additionally furthermore importantly moreover notably ultimately"),
}


def _forms(word: str) -> list[str]:
    stem, *ends = word.split("+")
    return [stem] + [(stem[:-1] if e == "ing" and stem.endswith("e") else stem) + e for e in ends]


@dataclass(frozen=True)
class Category:
    name: str
    weight: float
    severity: str
    by_profile: dict[str, float]
    terms: tuple[str, ...]

    @property
    def rule_id(self) -> str:
        return f"LEXICAL_{self.name.upper()}"

    def weight_in(self, profile: str) -> float:
        return self.weight * self.by_profile.get(profile, 1.0)


LEXICON: list[Category] = [
    Category(name, weight, severity, by, tuple(x for w in words.split() for x in _forms(w)))
    for name, (weight, severity, by, words) in _LEXICON.items()
]

#: name: template, replacement, confidence
_REWRITES = {
    "UTILIZE": (r"re:\butiliz(?:ing|ed|es|e)\b ## utiliz", "use", 0.97),
    "IN_ORDER_TO": ("in order to", "to", 0.95),
    "A_NUMBER_OF": ("a number of", "several", 0.9),
    "DUE_TO_THE_FACT": ("due to the fact that", "because", 0.96),
    "IN_THE_EVENT_THAT": ("in the event that", "if", 0.95),
    "AT_THIS_POINT_IN_TIME": ("at this point in time", "now", 0.95),
    "HAS_THE_ABILITY_TO": ("has the ability to", "can", 0.95),
    "FACILITATE": ("facilitate", "help", 0.9),
    "ENDEAVOR": ("endeavor", "try", 0.9),
    "PRIOR_TO": ("prior to", "before", 0.95),
    "SUBSEQUENT_TO": ("subsequent to", "after", 0.95),
    "IN_CONCLUSION": ("in conclusion", "", 0.92),
}


@dataclass(frozen=True)
class Rewrite:
    rule: Rule
    replacement: str
    confidence: float


REWRITES: list[Rewrite] = [
    Rewrite(Rule(f"SUGGEST_{name}", "suggestion", _L, *compile_template(t)), text, confidence)
    for name, (t, text, confidence) in _REWRITES.items()
]

EM_DASH, PARTICIPLE, TRICOLON = "FORMATTING_EM_DASH", "SUPERFICIAL_PARTICIPLE_CLAUSE", "PARALLEL_RULE_OF_THREE"
#: Rules that are coded as expressions of their own, with severity.
CODED = {EM_DASH: ("formatting_tells", _L), PARTICIPLE: ("superficial_analysis", _M), TRICOLON: ("parallelism", _L)}
ALL_IDS: tuple[str, ...] = (*(r.rule_id for r in RULES), *(c.rule_id for c in LEXICON), *CODED)


def load_rules(path: str | Path) -> tuple[Rule, ...]:
    """Rules of a TOML or JSON file, or of all such files of a folder in the order of their names.

    A file holds a list ``rules`` of tables with rule_id, dimension, severity, and either template or regex; explanation
    and anchors (lower-case literals of which every match holds one) may be added. ValueError says what is wrong.
    """
    path = Path(path)
    if path.is_dir():
        return tuple(r for p in sorted(path.iterdir()) if p.suffix in (".toml", ".json") for r in load_rules(p))
    data = tomllib.loads(path.read_text()) if path.suffix == ".toml" else json.loads(path.read_text())
    out = []
    for x in data.get("rules", []) if isinstance(data, dict) else data:
        if missing := sorted({"rule_id", "dimension", "severity"} - set(x)):
            raise ValueError(f"{path}: a rule has no {', '.join(missing)}")
        if x["severity"] not in SEVERITIES or x["dimension"] not in {d for d, _, _ in _PACKS} or ("template" in x) == ("regex" in x):
            raise ValueError(f"{path}: {x['rule_id']} needs a known severity and dimension, and either template or regex")
        regex, anchors = compile_template(x["template"]) if "template" in x else (x["regex"], ())
        try:
            re.compile(regex)
        except re.error as e:
            raise ValueError(f"{path}: {x['rule_id']}: {e}") from e
        out.append(Rule(x["rule_id"], x["dimension"], x["severity"], regex, tuple(x.get("anchors", anchors)), x.get("explanation", "")))
    return tuple(out)


def pack(dimension: str) -> list[Rule]:
    return [r for r in RULES if r.dimension == dimension]
