"""Word lists, letter tables and weights that results depend on."""

#: Latin letter groups and their Cyrillic letters; the first that fits at a place counts.
LATIN_TO_CYRILLIC = [
    ("shch", "щ"), ("sch", "щ"),
    ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"),
    ("yu", "ю"), ("ju", "ю"), ("ya", "я"), ("ja", "я"), ("yo", "е"), ("jo", "е"),
    ("ye", "е"), ("je", "е"), ("ck", "к"), ("qu", "кв"), ("ph", "ф"), ("th", "т"),
    ("a", "а"), ("b", "б"), ("c", "к"), ("d", "д"), ("e", "е"), ("f", "ф"),
    ("g", "г"), ("h", "х"), ("i", "и"), ("j", "й"), ("k", "к"), ("l", "л"),
    ("m", "м"), ("n", "н"), ("o", "о"), ("p", "п"), ("q", "к"), ("r", "р"),
    ("s", "с"), ("t", "т"), ("u", "у"), ("v", "в"), ("w", "в"), ("x", "кс"),
    ("y", "и"), ("z", "з"),
]

#: Cyrillic letters and their Latin groups in keys of items.
CYRILLIC_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo",
    "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch",
    "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}

STOPWORDS = [
    "вино", "wine", "россия", "russia", "оф", "of", "и", "in", "the", "de", "ооо", "зао", "ао", "гост", "литр", "объем",
    "алк", "alc", "vol", "год", "урожай",
]

#: Words that tell nothing on cards and labels; those of the text search above are another list.
CARD_STOPWORDS = [
    "вино", "wine", "вина", "россия", "russia", "крым", "кубань", "выдержанное", "коллекционное", "натуральное", "года", "год",
    "игристое",
]

#: Phrases of sweetness on labels and their values.
SWEETNESS = {
    "экстра брют": "экстра брют", "extra brut": "экстра брют", "брют натюр": "экстра брют", "brut nature": "экстра брют",
    "брют": "брют", "brut": "брют",
    "полусухое": "полусухое", "demi sec": "полусухое", "demi-sec": "полусухое", "semi dry": "полусухое", "semi-dry": "полусухое",
    "полусладкое": "полусладкое", "semi sweet": "полусладкое", "semi-sweet": "полусладкое", "demi doux": "полусладкое",
    "сладкое": "сладкое", "dolce": "сладкое", "sweet": "сладкое",
    "сухое": "сухое", "secco": "сухое",
}

#: Words of colour on labels and their values, in the order in which they are looked for.
COLOURS = {
    "белое": "белое", "белый": "белое", "blanc": "белое", "bianco": "белое",
    "красное": "красное", "красный": "красное", "rouge": "красное", "rosso": "красное",
    "розовое": "розовое", "rose": "розовое", "роза": "розовое",
    "оранжевое": "оранжевое", "orange": "оранжевое",
}

#: Parts of an item's key that tell sweetness and colour, in order.
KEY_SWEETNESS = [
    ("ekstra-bryut", "экстра брют"), ("ekstra-brut", "экстра брют"), ("extra-brut", "экстра брют"),
    ("polusuhoe", "полусухое"), ("polusladkoe", "полусладкое"), ("bryut", "брют"), ("brut", "брют"),
    ("suhoe", "сухое"), ("sladkoe", "сладкое"),
]
KEY_COLOURS = [("beloe", "белое"), ("krasnoe", "красное"), ("rozovoe", "розовое"), ("oranzhevoe", "оранжевое")]

#: Latin letters that look like Cyrillic ones.
LOOKALIKE_LATIN, LOOKALIKE_CYRILLIC = "abcehkmoptuxy", "аьсенкмортиху"

#: Latin names and their Cyrillic spellings.
ALIASES = {
    "tamagne": "тамань",
    "sauvignon": "совиньон", "cabernet": "каберне", "pinot": "пино", "merlot": "мерло", "noir": "нуар",
    "chardonnay": "шардоне", "riesling": "рислинг", "franc": "фран", "muscat": "мускат", "moscato": "мускат",
    "syrah": "сира", "shiraz": "шираз", "saperavi": "саперави", "rkatsiteli": "ркацители", "malbec": "мальбек",
    "aligote": "алиготе", "grigio": "гриджио", "gris": "гри", "ottonel": "оттонель", "chenin": "шенен",
    "traminer": "траминер", "gewurztraminer": "гевюрцтраминер", "vermentino": "верментино", "viognier": "вионье",
    "marselan": "марселан", "krasnostop": "красностоп", "kokur": "кокур", "tempranillo": "темпранильо",
    "sangiovese": "санджовезе", "semillon": "семильон", "meunier": "менье", "verdot": "вердо", "bastardo": "бастардо",
    "mourvedre": "мурведр", "zinfandel": "зинфандель", "magaracha": "магарача", "bianca": "бианка",
    "frizzante": "фриззанте",
}

#: Words that name any producer.
GENERIC_WORDS = [
    "вино", "вина", "винный", "винная", "винной", "винодельня", "винодельни", "виноделие", "винодельческий",
    "винодельческое", "усадьба", "имение", "поместье", "хозяйство", "семейная", "семейное", "агрофирма", "компания",
    "кооператив", "завод", "шато", "chateau", "winery", "wine", "wines", "estate", "vineyards", "вайнери",
]

#: Weights of the calibrated outcome: rows are the features and the constant, columns top-1, top-5 and absent.
FEATURES = ["dominance", "log_inliers", "cv_margin", "cv_lift", "coverage", "text_support", "text_conflict"]
OUTCOME_WEIGHTS = [
    [4.854491679424346, -7.310786405558986, 2.4562947261346495],
    [-0.5365649550395297, 1.3450886284269563, -0.8085236733874269],
    [4.108542007078386, -3.3294478338759297, -0.7790941732024679],
    [8.942892325583742, -2.858203674158601, -6.084688651425156],
    [3.269068719439784, -3.3250091994527433, 0.05594048001298749],
    [-0.4187237605367282, 0.6681863317275475, -0.24946257119082058],
    [-3.109353758784777, 1.5267968151361762, 1.5825569436486226],
    [-2.329732233439823, -1.1610690981187812, 3.490801331558589],
]
SHOW_P, CONFIDENT_P = 0.1, 0.3

#: Switches of the rules, by the names under which runs are recorded.
RULE_SWITCHES = [
    "TEXT_ALIASES", "OCR_JOIN", "NAME_FIRST", "LINE_BAND", "PLATFORM_SWEETNESS",
    "NAME_STRONG", "NAME_TRANSLIT", "GROUP_LEADER", "DEMOTE_GEOMETRY", "DEMOTE_DEPTH",
    "LABEL_BAND", "KIN_GROUP", "BRAND_FIRST", "GEOM_WEIGHT", "GEOM_WEIGHT_ALPHA",
    "SIFT_MAX_SIDE", "SIFT_DIR", "YOLO_WEIGHTS", "YOLO_CONF", "YOLO_IMGSZ",
    "PLATFORM_ADDITIONS", "GEOMETRY_MARGIN", "SIFT_ONE_TO_ONE",
    "SIFT_UNIQUE_INLIERS", "TEXT_VOTE",
]
