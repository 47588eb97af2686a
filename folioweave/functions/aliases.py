"""Latin and English names under which works of the Fathers, Aristotle and two later authors are cited, as ordered rules for ``linkage.first_rule``."""

from __future__ import annotations

#: Authors as cited.
AUGUSTINE = r"^(?:st\.?\s+|saint\s+)?augustin(?:e|us)?\.?(?:\s+of\s+hippo)?$"
DAMASCENE = r"^(?:st\.?\s+|saint\s+)?(?:john\s+)?(?:damascene|of\s+damascus)\.?$"

#: Fixed values: (book id, title pattern, location pattern or None) of Augustine's works, longer titles before those they start with.
_AUGUSTINE = (
    ("npnf103-on-the-holy-trinity", r"^de trin", None),
    ("npnf102-city-of-god", r"^(?:de civ|city of god)", None),
    ("npnf107-ten-homilies-on-the-first-epistle-of-john", r"^(?:in (?:prim|i|1)\b.*joan|tract\.? in (?:i\.? |1 |prim\.? )?ep)", None),
    ("npnf107-lectures-or-tractates-on-the-gospel-according-to-st-john", r"^(?:(?:super |in )?(?:joan|ioa)[a-z]*\.?,? tract|tract\.? (?:in|super) (?:joan|ioa))", None),
    ("npnf107-ten-homilies-on-the-first-epistle-of-john", r"^tract\.?$", r"\bep(?:ist)?\b.*\b(?:joan|ioa|john)"),
    ("npnf107-lectures-or-tractates-on-the-gospel-according-to-st-john", r"^tract\.?$", r"\b(?:joan|ioa|john)"),
    ("npnf102-on-christian-doctrine", r"^de doctr", None),
    ("npnf101-the-confessions", r"^confess", None),
    ("npnf104-reply-to-faustus-the-manich-an", r"^con(?:tra|t)?\.? faust", None),
    ("npnf103-the-enchiridion", r"^enchir", None),
    ("npnf106-our-lord-s-sermon-on-the-mount", r"^de serm\.? dom", None),
    ("npnf101-letters-of-st-augustin", r"^ep(?:ist)?\.?(?: ad\b.*)?$", None),
    ("npnf103-on-the-good-of-marriage", r"^de bono conj", None),
    ("npnf103-on-the-good-of-widowhood", r"^de bono vid", None),
    ("npnf103-on-care-to-be-had-for-the-dead", r"^de cura", None),
    ("npnf107-two-books-of-soliloquies", r"^soliloq", None),
    ("npnf103-of-the-work-of-monks", r"^de oper", None),
    ("npnf106-the-harmony-of-the-gospels", r"^de cons(?:ens(?:u)?)?\.? evang", None),
    ("npnf104-on-the-morals-of-the-catholic-church", r"^de mor(?:ibus|ib)?\.? eccl", None),
    ("npnf104-on-the-morals-of-the-manich-ans", r"^de mor(?:ibus|ib)?\.? manich", None),
    ("npnf103-of-holy-virginity", r"^de (?:sanct(?:a)?\.? )?virg", None),
    ("npnf103-on-continence", r"^de contin", None),
    ("npnf103-on-patience", r"^de patient", None),
    ("npnf105-a-treatise-on-nature-and-grace", r"^de nat(?:ura)?\.? et grat", None),
    ("npnf105-a-treatise-on-the-predestination-of-the-saints", r"^de pr(?:a|ae)ed(?:est)?\.? sanct", None),
    ("npnf105-a-treatise-on-the-predestination-of-the-saints", r"^de (?:dono )?persev", None),
    ("npnf105-on-marriage-and-concupiscence", r"^de nupt?\.? et concup", None),
    ("npnf104-concerning-the-nature-of-good-against-the-manich-ans", r"^de nat(?:ura)?\.? boni", None),
    ("npnf103-against-lying", r"^contra mend", None),
    ("npnf103-on-lying", r"^(?:lib\.? )?de mend", None),
    ("npnf105-a-treatise-on-the-spirit-and-the-letter", r"^de spir(?:itu)?\.? et lit", None),
    ("npnf104-on-two-souls-against-the-manich-ans", r"^de duab(?:us)?\.? anim", None),
    ("npnf105-a-treatise-concerning-man-s-perfection-in-righteousness", r"^de perf(?:ect)?\.? just", None),
    ("npnf105-a-treatise-on-rebuke-and-grace", r"^de cor(?:r|rep)\.? et grat", None),
    ("npnf105-a-treatise-on-the-merits-and-forgiveness-of-sins-and-on-the", r"^de pecc(?:at(?:orum)?)?\.? merit", None),
    ("npnf105-a-treatise-on-the-grace-of-christ-and-on-original-sin", r"^de grat(?:ia)?\.? christ", None),
    ("npnf105-a-treatise-on-the-soul-and-its-origin", r"^de anima et", None),
    ("npnf105-a-work-on-the-proceedings-of-pelagius", r"^de gest(?:is)?\.? pelag", None),
    ("npnf105-a-treatise-against-two-letters-of-the-pelagians", r"^contra duas ep", None),
    ("npnf104-on-baptism-against-the-donatists", r"^de bapt", None),
    ("npnf104-answer-to-the-letters-of-petilian-the-donatist", r"petil", None),
    ("npnf104-against-the-epistle-of-manich-us-called-fundamental", r"^contra ep(?:ist)?\.? fund", None),
    ("npnf104-acts-or-disputation-against-fortunatus-the-manich-an", r"fortun", None),
    ("npnf103-on-the-catechising-of-the-uninstructed", r"^de catech", None),
    ("npnf103-on-the-profit-of-believing", r"^de util", None),
    ("npnf103-concerning-faith-of-things-not-seen", r"^de fide rerum", None),
    ("npnf103-a-treatise-on-faith-and-the-creed", r"^de fide et symb", None),
    ("npnf103-on-the-creed", r"^de symb", None),
    ("npnf108-expositions-on-the-book-of-psalms", r"^(?:enarr|in ps)", None),
)
_DAMASCENE = (("npnf209-an-exact-exposition-of-the-orthodox-faith", r"^de fide orth", None),)

ARISTOTLE = r"^(?:the\s+)?(?:philosopher|aristot(?:le|\.)?)\.?$"
BOETHIUS = r"^(?:st\.?\s+)?boethius\.?$"
AQUINAS = r"^(?:(?:st\.?|s\.|saint)\s+)?(?:thom(?:as|\.)?(?:\s+(?:of\s+)?aquinas)?|aquinas)\.?$"

#: Aristotle's works, as above.
_ARISTOTLE = (
    ("aristotle-eudemian-ethics", r"^eth(?:ic)?\.?\s*eud", None),
    ("aristotle-nicomachean-ethics", r"^(?:ethic|ethics\b|eth\.?\s*ni[ch]|ni[ch]+(?:om)?\.?\s*eth|nicomachean|vic\.?\s*ethic)", None),
    ("aristotle-metaphysics", r"^met(?:aph(?:ysics|ysica|ys)?)?\.?$", None),
    ("aristotle-on-the-soul", r"^de anim(?:a|\.)?$", None),
    ("aristotle-rhetoric", r"^rhet(?:oric|or)?\.?$", None),
    ("aristotle-physics", r"^phys(?:ics|ica|ic)?\b\.?", None),
    ("aristotle-politics", r"^pol(?:it(?:ics|ic)?)?\.?$", None),
    ("aristotle-topics", r"^top(?:ic|ics)?\.?$", None),
    ("aristotle-posterior-analytics", r"^(?:poster|post\.?\s*analyt|an\.?\s*post)", None),
    ("aristotle-prior-analytics", r"^prior", None),
    ("aristotle-categories", r"^(?:categ|praedic)", None),
    ("aristotle-on-interpretation", r"^(?:\d+\s+)?peri\s*herm|^de\s*interp", None),
    ("aristotle-on-sophistical-refutations", r"^(?:de\s*soph|elench)", None),
    ("aristotle-on-the-heavens", r"^de\s*c(?:oel|œl|ael|eel)", None),
    ("aristotle-on-the-generation-of-animals", r"^de\s*gener(?:at)?\.?\s*anim", None),
    ("aristotle-on-generation-and-corruption", r"^de\s*gener(?:at)?\.?(?:\s*et\s*corr.*)?$", None),
    ("aristotle-on-the-parts-of-animals", r"^de\s*part\.?\s*anim", None),
    ("aristotle-history-of-animals", r"^(?:de\s*)?hist\.?\s*anim|^h\.\s*a\.$|^historia\s*animalium", None),
    ("aristotle-on-memory-and-reminiscence", r"^de\s*memor", None),
    ("aristotle-on-sleep-and-sleeplessness", r"^de\s*somn(?:o|\.)?\s*et\s*vig", None),
    ("aristotle-on-longevity-and-shortness-of-life", r"^de\s*long", None),
    ("aristotle-on-sense-and-the-sensible", r"^de\s*sensu", None),
    ("aristotle-on-prophesying-by-dreams", r"^divin", None),
    ("aristotle-poetics", r"^poet", None),
    ("aristotle-on-virtues-and-vices", r"^de\s*virt", None),
)
_BOETHIUS = (("boethius-consolation-of-philosophy", r"^de\s*consol", None),)
_CONTRA_GENTILES = (("summa-contra-gentiles", r"^(?:summa\s*)?(?:contra|cont\.?|c\.)\s*gent", None),)

#: What a place starts with in works that the volumes hold as parts of another, by their title pattern.
PREFIXES = {r"^de pr(?:a|ae)ed(?:est)?\.? sanct": [("book", 1)], r"^de (?:dono )?persev": [("book", 2)]}

#: How places are read in works whose pages do not tell.
TYPES = {"boethius-consolation-of-philosophy": ["book", "prose"]}


def _rules(author: str, works: tuple) -> list[tuple[str, dict[str, str]]]:
    return [(book, {"author": author, "title": title} | ({"location": where} if where else {})) for book, title, where in works]


FATHERS = _rules(AUGUSTINE, _AUGUSTINE) + _rules(DAMASCENE, _DAMASCENE)
PHILOSOPHER = _rules(ARISTOTLE, _ARISTOTLE)
MEDIEVALS = _rules(BOETHIUS, _BOETHIUS) + _rules(AQUINAS, _CONTRA_GENTILES)
