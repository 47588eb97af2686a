"""Who wrote the works of each volume, as rules for ``volumes.author``."""

from __future__ import annotations

from typing import Any

_ANONYMOUS = "Anonymous"

#: By volume, (pattern, author) for a work's own title, then for the titles around it, then the volume's author.
VOLUME_AUTHORS: dict[str, dict[str, Any]] = {
    "anf01": {
        "works": [(r"martyrdom of polycarp", "Church of Smyrna"), (r"martyrdom of (?:ignatius|justin)", _ANONYMOUS)],
        "within": [
            (r"clement of rome", "Clement of Rome"), (r"mathetes", "Mathetes"), (r"polycarp", "Polycarp"), (r"ignatius", "Ignatius of Antioch"),
            (r"barnabas", "Barnabas"), (r"papias", "Papias"), (r"justin", "Justin Martyr"), (r"irenaeus", "Irenaeus"),
        ],
    },
    "anf02": {
        "works": [(r"hermas", "Hermas")],
        "within": [(r"tatian", "Tatian"), (r"theophilus", "Theophilus of Antioch"), (r"athenagoras", "Athenagoras"), (r"clement of alexandria", "Clement of Alexandria")],
    },
    "anf03": {"author": "Tertullian"},
    "anf04": {
        "works": [(r"to origen from africanus", "Julius Africanus")],
        "within": [(r"tertullian", "Tertullian"), (r"minucius", "Minucius Felix"), (r"commodian", "Commodian"), (r"origen", "Origen")],
    },
    "anf05": {
        "works": [
            (r"by pontius", "Pontius the Deacon"), (r"council of carthage", "Council of Carthage"),
            (r"attributed to cyprian", "Pseudo-Cyprian"), (r"appendix to the works of hippolytus", "Pseudo-Hippolytus"),
        ],
        "within": [(r"hippolytus", "Hippolytus"), (r"cyprian", "Cyprian"), (r"caius", "Caius"), (r"novatian", "Novatian"), (r"appendix", _ANONYMOUS)],
    },
    "anf06": {
        "works": [(r"julius africanus", "Julius Africanus"), (r"^pieri?us", "Pierius of Alexandria"), (r"^pamphilus", "Pamphilus"), (r"^malchion", "Malchion")],
        "within": [
            (r"gregory thaumaturgus", "Gregory Thaumaturgus"), (r"anatolius of alexandria", "Anatolius of Alexandria"),
            (r"alexander of cappadocia", "Alexander of Jerusalem"), (r"theognostus", "Theognostus of Alexandria"),
            (r"theonas", "Theonas of Alexandria"), (r"phileas", "Phileas of Thmuis"), (r"archelaus", "Archelaus"),
            (r"alexander of lycopolis", "Alexander of Lycopolis"), (r"peter of alexandria", "Peter of Alexandria"),
            (r"alexander of alexandria", "Alexander of Alexandria"), (r"methodius", "Methodius"), (r"arnobius", "Arnobius"), (r"^dionysius", "Dionysius of Alexandria"),
        ],
    },
    "anf07": {
        "works": [
            (r"^venantius", "Venantius"), (r"asterius", "Asterius Urbanus"), (r"^dionysius", "Dionysius of Rome"),
            (r"teaching of the twelve apostles|constitutions of the holy apostles|liturgies", _ANONYMOUS),
            (r"second epistle of clement", "Pseudo-Clement"), (r"nicene creed", "First Council of Nicaea"),
        ],
        "within": [(r"lactantius", "Lactantius"), (r"victorinus", "Victorinus of Pettau")],
    },
    "anf08": {
        "works": [
            (r"twelve patriarchs", _ANONYMOUS), (r"theodotus", "Clement of Alexandria"), (r"zephyrinus", "Zephyrinus"), (r"pope urban", "Urban I"),
            (r"pontianus", "Pontianus"), (r"anterus", "Anterus"), (r"decrees of fabian", "Fabian"), (r"mar jacob", "Jacob of Serugh"),
            (r"moses of chorene", "Moses of Chorene"), (r"bardesan", "Bardaisan"), (r"mara,? son of serapion", "Mara bar Serapion"),
            (r"^ambrose", "Ambrose (Syriac apologist)"), (r"^quadratus", "Quadratus of Athens"), (r"^aristo of pella", "Aristo of Pella"),
            (r"^melito", "Melito of Sardis"), (r"^dionysius, bishop of corinth", "Dionysius of Corinth"), (r"^rhodon", "Rhodon"),
            (r"^maximus", "Maximus of Jerusalem"), (r"^claudius apollinaris", "Claudius Apollinaris"), (r"^polycrates", "Polycrates of Ephesus"),
            (r"^theophilus, bishop of caesarea", "Theophilus of Caesarea"), (r"^serapion", "Serapion of Antioch"), (r"^apollonius", "Apollonius"),
            (r"^pantaenus", "Pantaenus"), (r"^pseud-irenaeus", "Pseudo-Irenaeus"),
        ],
        "within": [
            (r"two epistles concerning virginity|pseudo-clementine", "Pseudo-Clement"), (r"pope callistus", "Callistus I"), (r"pope fabian", "Fabian"),
            (r"hegesippus", "Hegesippus"), (r"apocrypha|memoirs of edessa", _ANONYMOUS),
        ],
    },
    "anf09": {
        "works": [
            (r"gospel of peter|apocalypse of peter|vision of paul|apocalypse of the virgin|sedrach", _ANONYMOUS),
            (r"testament of abraham|xanthippe|zosimus|scillitan", _ANONYMOUS), (r"second epistle of clement", "Pseudo-Clement"),
            (r"aristides", "Aristides of Athens"), (r"origen", "Origen"),
        ],
        "within": [(r"diatessaron", "Tatian"), (r"epistles of clement", "Clement of Rome"), (r"origen", "Origen")],
    },
    **{f"npnf1{n:02}": {"author": "Augustine of Hippo" if n < 9 else "John Chrysostom"} for n in range(1, 15)},
    "npnf201": {"works": [(r"oration of constantine", "Constantine the Great")], "author": "Eusebius of Caesarea"},
    "npnf202": {"works": [(r"socrates", "Socrates Scholasticus"), (r"sozomen", "Sozomen")]},
    "npnf203": {
        "works": [
            (r"anathemas of cyril", "Cyril of Alexandria"), (r"theodoret", "Theodoret"), (r"^jerome|jerome's apology", "Jerome"),
            (r"^gennadius", "Gennadius of Massilia"), (r"letter of anastasius", "Anastasius I"), (r"pamphilus' defence", "Pamphilus"),
        ],
        "within": [(r"theodoret", "Theodoret"), (r"rufinus", "Rufinus of Aquileia")],
    },
    "npnf204": {"works": [(r"letter of eusebius", "Eusebius of Caesarea"), (r"historia acephala", _ANONYMOUS)], "author": "Athanasius"},
    "npnf205": {"author": "Gregory of Nyssa"},
    "npnf206": {"author": "Jerome"},
    "npnf207": {"works": [(r"cyril", "Cyril of Jerusalem"), (r"gregory nazianzen", "Gregory of Nazianzus")], "within": [(r"gregory nazianzen", "Gregory of Nazianzus")]},
    "npnf208": {"author": "Basil of Caesarea"},
    "npnf209": {"within": [(r"john of damascus", "John of Damascus")], "author": "Hilary of Poitiers"},
    "npnf210": {"author": "Ambrose of Milan"},
    "npnf211": {"works": [(r"vincent of lerins", "Vincent of Lérins")], "within": [(r"sulpitius", "Sulpicius Severus"), (r"cassian", "John Cassian")]},
    "npnf212": {"within": [(r"leo the great", "Leo the Great"), (r"gregory the great", "Gregory the Great")]},
    "npnf213": {"works": [(r"gregory the great", "Gregory the Great"), (r"ephraim", "Ephrem the Syrian"), (r"aphrahat", "Aphrahat")]},
    "npnf214": {
        "works": [
            (r"(?:epistle|letter|anathematisms?) of (?:st\. )?cyril", "Cyril of Alexandria"), (r"tome of st\. leo", "Leo the Great"),
            (r"pope coelestine", "Celestine I"), (r"under nectarius", "Council of Constantinople (394)"), (r"under cyprian", "Council of Carthage (256)"),
            (r"second council of constantinople", "Second Council of Constantinople"), (r"third council of constantinople", "Third Council of Constantinople"),
            (r"apostolical canons|appendix containing canons", _ANONYMOUS),
        ],
        "within": [
            (r"first council of nice", "First Council of Nicaea"), (r"ancyra", "Council of Ancyra"), (r"neocaesarea", "Council of Neocaesarea"),
            (r"gangra|grangra", "Council of Gangra"), (r"antioch in encaeniis", "Synod of Antioch"), (r"laodicea", "Synod of Laodicea"),
            (r"first council of constantinople", "First Council of Constantinople"), (r"council of ephesus", "Council of Ephesus"),
            (r"chalcedon", "Council of Chalcedon"), (r"trullo", "Council in Trullo"), (r"sardica", "Council of Sardica"),
            (r"carthage", "Council of Carthage"), (r"second council of nice", "Second Council of Nicaea"),
        ],
    },
}
