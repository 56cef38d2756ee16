"""Word lists and spelling tables of the scorers and normalisers."""

from __future__ import annotations

from functools import lru_cache

from .spellings import common_form

# Fillers of the lexical scorer and of the intended-text rules.
FILLERS_WIDE = "ah eh er erm hm hmm hmmm mhm mm mmm mmmm mm-hm mm-hmm uh uh-huh uhh uhm um umm".split()
# Fillers and nasal variants of the canonical scorer.
FILLERS = "ah eh er erm huh mm uh uh-huh um".split()
NASAL_VARIANTS = "hm hmm hmmm m-hm m-hmm mhm mm mm-hm mm-hmm mmhm mmm mmmm".split()
BRACKETED_WORDS = [*FILLERS, "hmm", "mmm"]
# Reduced forms that are scored as events.
SMALL_FORMS = "coulda dunno gonna gotta kinda shoulda sorta wanna woulda".split()
# Marks in token lists.
UNCLEAR, CLITIC_S = "<unclear>", "<clitic-s>"

# Written conventions with one spoken form.
CANONICAL = dict(
    line.split()
    for line in """
mr mister
mrs missus
ms miz
dr doctor
prof professor
rev reverend
sgt sergeant
jr junior
sr senior
cr councilor
councillor councilor
acknowledgement acknowledgment
acknowledgements acknowledgments
behaviour behavior
behaviours behaviors
cancelled canceled
cancelling canceling
catalogue catalog
catalogues catalogs
catalogued cataloged
cataloguing cataloging
centre center
centres centers
centred centered
centring centering
cheque check
cheques checks
colour color
colours colors
coloured colored
colouring coloring
defence defense
defences defenses
enrol enroll
enrols enrolls
enrolment enrollment
enrolments enrollments
favour favor
favours favors
favoured favored
favouring favoring
favourite favorite
favourites favorites
flavour flavor
flavours flavors
fulfil fulfill
fulfils fulfills
fulfilment fulfillment
grey gray
honour honor
honours honors
honoured honored
honouring honoring
honourable honorable
humour humor
kerb curb
kerbs curbs
labour labor
labours labors
laboured labored
labouring laboring
licence license
licences licenses
litre liter
litres liters
metre meter
metres meters
neighbour neighbor
neighbours neighbors
neighbourhood neighborhood
neighbourhoods neighborhoods
offence offense
offences offenses
practise practice
practised practiced
practising practicing
pretence pretense
programme program
programmes programs
theatre theater
theatres theaters
traveller traveler
travellers travelers
travelled traveled
travelling traveling
tyre tire
tyres tires
""".split("\n")
    if line
)
# Regional vocabulary or pronunciation, not spelling; stays apart.
NOT_SPELLING = "aeroplane airplane bougie bogie louth loth mum mom rolland roland titbit tidbit titbits tidbits".split()


@lru_cache(4)
def spelling_table(path: str | None) -> dict[str, str]:
    """A further table of (regional, common) spellings, tab-separated; entries of ``NOT_SPELLING`` are left out."""
    if not path:
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = [line.rstrip("\n").split("\t")[:2] for line in f if "\t" in line]
    return {a: b for a, b in pairs if a not in NOT_SPELLING and b not in NOT_SPELLING}


@lru_cache(1 << 16)
def canonical_word(word: str, table: str | None = None) -> str:
    """One spelling of a folded lower-case word: conventions first, then the table given, then the rules."""
    if word in CANONICAL:
        return CANONICAL[word]
    extra = spelling_table(table)
    if word in extra:
        return extra[word]
    return word if word in NOT_SPELLING else CANONICAL.get(common := common_form(word), common)
