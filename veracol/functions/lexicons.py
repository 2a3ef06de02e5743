"""Word lists, patterns and lookup rows. Results depend on these exact entries."""

from __future__ import annotations

import json
from importlib import resources

# Connectors of academic Russian.
CONNECTORS = (
    "таким образом", "следовательно", "в связи с этим", "однако", "в частности", "как правило", "кроме того",
    "в соответствии с", "с одной стороны", "с другой стороны", "в то же время", "тем не менее",
    "из этого следует, что", "на основании полученных данных", "как показано на",
)
# clichés of academic Russian.
CLICHES = (
    "важно отметить, что", "следует отметить, что", "следует подчеркнуть, что", "необходимо подчеркнуть, что",
    "обращает на себя внимание тот факт, что", "необходимо обратить внимание на то, что",
    "исходя из этого, можно утверждать, что", "в данном контексте", "в современной науке",
    "играет ключевую роль", "играет важную роль", "является неотъемлемой частью", "широкий спектр",
    "как упоминалось ранее", "как было сказано выше", "с целью повышения эффективности", "представляет собой",
    "на сегодняшний день", "в рамках данного исследования", "особое внимание уделяется",
)
# Words that explain a formula.
FORMULA_WORDS = ("где", "обозначает", "выражает", "при этом", "определяется как")
# Headers that open a bibliography, by priority.
BIBLIOGRAPHY_HEADERS = ("список литературы", "литература", "references", "библиографический список")
# Disciplines by keyword, first match wins.
DISCIPLINE_KEYWORDS = (
    ("AUTOMATION_CONTROL", ("управление", "робот", "автоматиз", "регулятор", "динамик", "control", "robot", "automat", "cybernetic", "feedback")),
    ("AGRI_MED", ("биолог", "медиц", "клетк", "терап", "ген", "biolog", "medic", "cell", "gene", "patient", "clinical", "dna", "rna")),
    ("SCI_TECH", ("физик", "хими", "сплав", "материал", "энерг", "physic", "chemic", "material", "alloy", "thermodynamic", "mechanic")),
    ("HUM_POL_ECON", ("эконом", "полити", "гуманитар", "истори", "обществ", "econom", "polit", "social", "humanit", "history", "societ")),
    ("ARTS_SPORTS", ("искусств", "спорт", "культур", "музык", "art", "sport", "cultur", "music", "athlet", "paint")),
)
DEFAULT_DISCIPLINE = "UNIVERSAL"
# Discipline, ppl_low, ppl_high, nv_ratio_max, passive_max.
CALIBRATION = (
    ("SCI_TECH", 9.0, 90.0, 4.5, 3),
    ("AUTOMATION_CONTROL", 8.0, 85.0, 5.0, 4),
    ("AGRI_MED", 12.0, 80.0, 4.0, 2),
    ("HUM_POL_ECON", 14.0, 75.0, 3.0, 1),
    ("ARTS_SPORTS", 15.0, 75.0, 2.5, 1),
    ("UNIVERSAL", 12.0, 80.0, 4.0, 2),
)
CALIBRATION_SCHEMA = "discipline string, ppl_low double, ppl_high double, nv_ratio_max double, passive_max int"
# Markers of a scientific inference.
INFERENCE_MARKERS = ("показывает", "доказывает", "следовательно", "таким образом", "в результате", "предложено", "разработано", "поэтому", "вывод", "иллюстрирует")
# Evidence need by lemma, in order.
EVIDENCE_LEMMAS = (
    ("low", ("известный", "очевидный", "аксиома", "общепризнанный", "правило", "классический")),
    ("medium", ("предложить", "разработать", "создать", "впервые", "новизна", "получить", "автор", "работа")),
    ("high", ("потому", "вследствие", "показывать", "доказывать", "превосходить", "увеличивать", "снижать", "эксперимент", "свойство")),
)
# Workflows by keyword, in order.
WORKFLOWS = (
    ("citation_audit", ("citation", "reference", "audit", "gap", "gost", "nli", "ссылк", "литератур", "библиограф", "гост", "ппл", "ppl", "проверить", "引用", "文献", "支撑")),
    ("literature_landscape", ("dissercat", "zotero", "elibrary", "cyberleninka", "rsl", "landscape", "похожие", "диссертаци", "сравн", "обзор", "同方向", "对比", "文献调研", "别人怎么写")),
    ("planning_and_structure", ("structure", "plan", "chapter", "outline", "experiment", "methodology", "структур", "план", "глав", "эксперимент", "методологи", "введен", "актуальност", "новизн", "положен", "защит", "规划", "结构", "章节", "开题", "导师")),
)
DEFAULT_WORKFLOW = "polishing_and_style"
# Required sections of a dissertation; any alternative counts.
SECTIONS = (
    ("relevance", ("актуальность темы", "актуальность исследования")),
    ("degree_developed", ("степень разработанности",)),
    ("goal_tasks", ("цель и задачи", "цель исследования", "задачи исследования")),
    ("novelty", ("научная новизна",)),
    ("significance", ("теоретическая и практическая значимость", "теоретическая значимость", "практическая значимость")),
    ("methodology", ("методология и методы", "методология исследования", "методы исследования")),
    ("provisions", ("положения, выносимые на защиту", "на защиту выносятся")),
    ("reliability", ("достоверность и апробация", "степень достоверности", "апробация результатов", "апробация работы")),
)
# Words that no title is told by.
TITLE_STOP_WORDS = (
    "the", "and", "for", "with", "from", "journal", "proceedings", "conference", "arxiv", "preprint", "volume",
    "issue", "pages", "editorial", "letter", "analysis", "study", "research", "paper", "method", "methods", "using",
    "based",
)
# Suffixes of the light stemmer.
SUFFIXES = (
    "ческого", "ческому", "ческих", "ческими", "ческом", "ческое", "ческая", "ческие", "ческий", "ческую", "ческой",
    "ующими", "ующего", "ующему", "ующих", "ующем", "тельного", "тельному", "тельных", "тельным", "тельном", "ание",
    "ания", "анию", "анием", "ании", "ение", "ения", "ению", "ением", "ении", "ать", "еть", "ить", "овать", "ывать",
    "ировать", "ского", "скому", "ских", "скими", "ском", "ного", "ному", "ных", "ным", "ном", "ное", "ная", "ные",
    "ный", "ную", "ной", "ову", "ова", "ове", "овом", "овы", "ого", "ему", "ому", "ыми", "ями", "ях", "ом", "ой",
    "ей", "ем", "ах", "их", "ых", "ие", "ия", "ию", "ии", "ием", "ией", "иями", "иях", "ое", "ая", "ее", "ый", "ий",
    "ые", "ов", "ев", "а", "е", "и", "й", "о", "у", "ы", "ь", "я",
)


def specialties() -> list[dict]:
    """The packaged nomenclature of specialties."""
    return json.loads(resources.files("veracol").joinpath("data/specialties.json").read_text(encoding="utf-8"))
