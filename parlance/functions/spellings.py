"""Regional spellings of English words and their common forms, by rules of stems and endings."""

from __future__ import annotations

import re

# What stands before -ise where that is no suffix (adverti-se, expertise, wise ...).
NOT_ISE = frozenset(
    """
adv advert anyw appra ar bra bru chas chast chor circumc clockw compr comprom conc counterpo cr cru dem desp dev disenfranch disgu dispra edgew
enfranch enterpr exc exerc expert franch gu improv inc lengthw lia likew mala marqu mayonna merchand no otherw parad perqu po porpo pra pract prec prem
prom repr rev sem sunr superc superv surm surpr telev tort torto treat underw unw upra widthw crossw cer val mort
""".split()
)
ISE = re.compile(r"is(ations?|ational(?:ly)?|abl[ey]|ability|ances?|ants?|ements?|ers?|ing(?:ly|s)?|ed(?:ly)?|es?)$")
YSE = re.compile(r"(?<=[a-z]{3}l)ys(e[drs]?|ers|ing)$")
# Stems before -our, -ll-, -re and -l, and stems with ae or oe, with their endings.
OUR = re.compile(
    "(arb|ard|arm|behavi|belab|lab|cand|clam|clang|col|meano?|emean|enam|endeav|fav|ferv|flav|harb|hon|hum|neighb|od|parl|ranc|rig|rum|savi|sav|splend|succ|tum|val|vap|vig)"
    "our(s|ed|ing|ings|er|ers|y|ies|ful|fully|less|liness|ly|al|ally|ism|able|ably|ableness|ite|ites|itism|hood|hoods)?$"
)
LL = re.compile(
    "(bedevi|beve|cance|caro|cavi|channe|chise|counci|counse|crue|cudge|devi|dia|disembowe|enthra|disheve|drive|due|ename|equa|fue|funne|gambo|grove|grue|imperi|initia|jewe|kenne"
    "|labe|leve|libe|marsha|marve|mode|pane|parce|peda|penci|pumme|quarre|rave|reve|riva|shove|shrive|signa|snive|spira|stenci|swive|teetota|tota|towe|tramme|trave|tunne|wease|yode)"
    "ll(ed|er|ers|ing|ist|ists|or|ors|ous|ously|ousness|est)$"
)
RE = re.compile("(theat|calib|lit|met|cent|fib|goit|lust|meag|mit|nit|reconnoit|sab|saltpet|scept|sepulch|somb|spect)re(s?)$")
MOULD = re.compile("^(re|s)?mou(ld|lt)(s|ed|ing|ings|er|ers|y|ier|iest|ered|ering)?$")
SINGLE_L = re.compile("^(enthra|appa|insti|disti|enro|fulfi)l(s|ment|ments)?$")
LOGUE = re.compile("^(ana|dia|homo|mono)logue$")
DIGRAPH = re.compile("^(aeon|aetiol|amoeb|anaem|anaesth|caec|caesi|coel|faec|foet|gynaec|haem|leukaem|oedem|oenol|oesoph|oestr|orthopaed|paed|palaeo|encyclopaed|diarrhoe|gonorrhoe)")
RULES = ((OUR, r"\1or\2"), (LL, r"\1l\2"), (RE, r"\1er\2"), (MOULD, r"\1mo\2\3"), (SINGLE_L, r"\1ll\2"), (LOGUE, r"\1log"), (re.compile("^tranquilliz"), "tranquiliz"))
# Spellings that no rule gives.
SINGLE = dict(
    pair.split(":")
    for pair in """
aluminium:aluminum blowsy:blowzy callipers:calipers chilli:chili cosier:cozier cosily:cozily curiae:curie faroes:fares manoeuvred:maneuvered manoeuvre:maneuver
manoeuvring:maneuvering manoeuvrs:maneuvers marshalls:marshals woollens:woolens woollen:woolen plough:plow jewellery:jewelry instalment:installment
instalments:installments enrolees:enrollees hilary:hillary barbel:barbell barbels:barbells skulduggery:skullduggery bourne:borne compere:compeer engravre:engraver
""".split()
)


def common_form(word: str) -> str:
    """The common form of a folded lower-case word; a word that no rule fits stays as it is."""
    if word in SINGLE:
        return SINGLE[word]
    if m := ISE.search(word):
        stem = word[: m.start()]
        if len(stem) > 2 and stem not in NOT_ISE:
            word = f"{stem}iz{m[1]}"
    elif m := YSE.search(word):
        return word[: m.start()] + "yz" + m[1]
    for pattern, to in RULES:
        if pattern.search(word):
            return pattern.sub(to, word)
    if m := DIGRAPH.match(word):
        return re.sub("[ao]e", "e", m[0]) + word[m.end() :]
    return word
