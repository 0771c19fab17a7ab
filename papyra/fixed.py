"""Word lists, patterns and constants that results depend on."""

# --- fixed values: letters and marks ---
ALEF_FORMS = "إأآٱ"
FOLDED_FROM, FOLDED_TO = "إأآٱىةؤئ", "اااايهوي"
TASHKEEL = "ؐ-ًؚ-ٰٟۖ-ۭ"
TATWEEL = "ـ"
BIDI_CONTROLS = "​-‏‪-‮⁦-⁩﻿­"
INVISIBLE = "​-‏‪-‮⁠-⁩﻿­؜"
CONTROL = "\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f"
PERSIAN_FROM, PERSIAN_TO = "یکۀھہے", "يكةههي"
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬", "01234567890123456789.,"
ABJAD = "أبجدهوزحطيكلمنسعفصقرشتثخذضظغ"
ARABIC_LETTERS = "أابتثجحخدذرزسشصضطظعغفقكلمنهوي"
TOKEN_PREFIXES = ("وال", "بال", "كال", "فال", "لل", "ال")

# --- fixed values: ordinals ---
UNIT_ORDINALS = {
    "الأول": 1, "الأولى": 1, "الحادي": 1, "الحادية": 1, "الثاني": 2, "الثانية": 2, "الثالث": 3, "الثالثة": 3,
    "الرابع": 4, "الرابعة": 4, "الخامس": 5, "الخامسة": 5, "السادس": 6, "السادسة": 6, "السابع": 7, "السابعة": 7,
    "الثامن": 8, "الثامنة": 8, "التاسع": 9, "التاسعة": 9, "العاشر": 10, "العاشرة": 10,
}
TENS_ORDINALS = {
    "العشرون": 20, "الثلاثون": 30, "الأربعون": 40, "الخمسون": 50, "الستون": 60, "السبعون": 70, "الثمانون": 80,
    "التسعون": 90, "المئة": 100, "المائة": 100,
}
ORDINAL_ADVERBS = ("أولا", "ثانيا", "ثالثا", "رابعا", "خامسا", "سادسا", "سابعا", "ثامنا", "تاسعا", "عاشرا")

# --- fixed values: headings, footnote marks and the margins of a document without lines of body size ---
_ORDINAL = r"(?:ال[ء-ي]+)(?:\s+(?:و?ال[ء-ي]+|عشرة?|بعد))*"
PART = rf"^الباب\s+({_ORDINAL})\s*(?::\s*(.+))?$"
CHAPTER = rf"^الفصل\s+({_ORDINAL})\s*(?::\s*(.+))?$"
ARTICLE = rf"^(المادة\s+)?({_ORDINAL})\s*:\s*(.+)$"
ANNEX = r"^(?:الملحق|ملحق)\s*\(?\s*(\d+(?:\s*-\s*\d+)?)\s*\)?(?:\s*\(([ء-ي])\))?\s*(?::\s*)?(.*)$"
FOOTNOTE_MARK = r"\[\^(\d+)\]"
FOOTNOTE_LINE = r"^(?:\[\^(\d+)\]|(\d+))\s+(.*)$"
FIRST_HEADING = r"^(الباب|الفصل) الأول$"
CONTENTS_TITLE = "المحتويات"
CLASSIFICATION = r"(?i)Internal\s*-\s*داخ\s*ل?ي?|داخلي\s*-\s*Internal"
LEFT_MARGIN, RIGHT_MARGIN = 70.0, 530.0

# --- fixed values: warnings that ask for a person's look ---
REVIEW_WARNINGS = (
    "OCR_UNAVAILABLE", "LOW_NATIVE_QUALITY_NO_OCR", "LOW_OCR_CONFIDENCE", "REVERSED_ARABIC", "LEGACY_ARABIC_ENCODING",
    "NATIVE_OCR_MISMATCH", "PAGE_FAILED", "AUTO_NUMBERING_MAY_BE_MISSING", "OCR_NUMBERS_UNVERIFIED", "UNREAD_DRAWN_TEXT",
)

# --- fixed values: what opens a block of text, punctuation around tokens read from images, addresses ---
BLOCK_OPENS = (
    r"\d{1,3}(?:\.\d{1,3})+\s+(?=\S)", r"\d{1,3}(?:\.\d{1,3})*(?:[\)\.\-–:]\s+|\s+(?=[A-Z])|\s*$)", r"\(\d{1,3}\)\s+", r"[•●▪◦■*\-–—]\s+",
    r"\(?[A-Za-z]\)\s+", r"[a-z]\.\s+", r"(?:article|section|chapter|clause|part|appendix)\s+\w+",
    r"(?:المادة|مادة|الباب|الفصل|القسم|البند|الفقرة|الملحق)\s", r"(?:اولا|ثانيا|ثالثا|رابعا|خامسا|سادسا|سابعا|ثامنا|تاسعا|عاشرا)\b", r"\(?[ا-ي][\)\.\-]\s",
)
EDGE_PUNCTUATION = "/,.:;|()[]{}«»\"'`’‘°©_~"
WEB_ADDRESS = r"(www\.[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[a-z]{2,4})"
MAX_EMAIL, MIN_PASSWORD = 254, 8

# --- fixed values: list markers, by style in order of precedence; group 1 is the number or letter ---
_NUMBER = "(\\d{1,2}|[" + ABJAD + "])"
MARKER_STYLES = (
    ("paren", f"^\\(\\s*{_NUMBER}\\s*\\)"),
    ("paren", f"^\\)\\s*{_NUMBER}\\s*\\("),
    ("close", f"^{_NUMBER}\\s*[)(]"),
    ("dot", f"^{_NUMBER}\\s*\\.(?:[^\\d]|$)"),
    ("dash", f"^{_NUMBER}\\s*[-–]"),
    ("dash", f"^[-–]\\s*{_NUMBER}\\s"),
    ("plain", "^(\\d{1,2})\\s+[^\\d\\s.)]"),
)
#: The label of a clause by style (# is the number or letter), and the title that may be glued to a text behind it.
CLAUSE_LABELS = {
    "plain": r"#\s+", "dot": r"#\s*\.\s*", "close": r"#\s*[)(]\s*", "paren": r"\(\s*#\s*\)\s*", "dash": r"(?:-\s*#|#\s*-)\s*",
}
GLUED_TITLE, GLUED_WORDS, GLUE_ENDS = r"\S[^.:؛]{1,60}(?::\s*)?", 8, (".", ":", "؛", ")")
BULLETS = "•●▪◦■‣⁃❖➢✓\\-–"
CONTENTS_HEADINGS = ("الفهرس", "فهرس المحتويات", "المحتويات", "جدول المحتويات")
CONTENTS_ENTRY = "(?:\\.{3,}|…)\\s*\\d{1,3}(?:\\D|$)"

# --- fixed values: words of the quality test ---
STOP_WORDS = (
    "في", "من", "على", "هذا", "التي", "الذي", "عن", "بين", "ذلك", "المادة", "الصندوق", "الاستثمار", "الهيئة",
    "المستثمر", "الى", "الصناديق", "المالية",
)
#: Words that stand alone however short (of split-word repair).
SHORT_WORDS = (
    "في", "من", "عن", "علي", "الي", "او", "ان", "لا", "ما", "قد", "لم", "لن", "هو", "هي", "هم", "مع", "ثم",
    "كل", "اي", "بل", "لو", "اذ", "اذا", "تم", "اما", "الا", "اول", "غير", "بين", "عند", "بعد", "قبل", "حتي",
    "ذلك", "تلك", "هذا", "هذه", "التي", "الذي", "كان", "له", "لها", "لهم", "به", "بها", "منه", "منها", "فيه",
    "فيها", "عليه", "حال", "يوم", "عام", "سنة", "مدة", "حق", "حد", "نص", "رقم", "اسم", "عدد", "نوع", "اذن",
)
WORD_PREFIXES = ("وبال", "وال", "فال", "بال", "كال", "لل", "ال", "و", "ف", "ب", "ل", "ك")

# --- fixed values: sections, scopes, references ---
PINNED_SECTION = "IFR-anx11"
DOC_CODES = {
    "investment_funds_regulations": "IFR", "capital_market_institutions_regulations": "CMIR",
    "corporate_governance_regulations": "CGR", "simplified_investment_funds_instructions": "SIFI",
}
DOC_HINTS = (("مؤسسات السوق", "CMIR"), ("حوكمة الشركات", "CGR"), ("المبسطة", "SIFI"), ("صناديق الاستثمار", "IFR"))
OUTSIDE = ("نظام السوق المالية", "نظام الشركات", "نظام مكافحة")
REFERENCE = "(?:ب|ل|و|ف)?(?:ال|ل)?(ماده|ملحق)\\s*(?:رقم\\s*)?\\(?\\s*(\\d{1,3})\\s*\\)?"
ABLATIONS = ("no_rerank_clause", "no_lexical", "no_topics", "no_title", "no_named", "no_annex_item")

# --- fixed values: sizes and weights ---
MAX_WORDS, BALANCE = 300, 1.2
BM25_K1, BM25_B = 1.5, 0.75
RRF_K, RRF_CANDIDATES, RERANK_CANDIDATES = 60, 50, 20
FUSION_WEIGHTS = {"clause": 1.0, "lexical": 0.6, "topic": 0.9, "title": 0.5}
MAX_TOPICS, MAX_NAMED, SEARCH_DEPTH, POOL_SIZE, MAX_SELECTED, EXCERPT_CHARS, CLAUSE_CHARS = 4, 3, 20, 18, 8, 1100, 3000
MIN_CLAUSES, TITLE_WORDS, FRONT_SHARE, CLAUSE_SHARE = 5, 15, 0.4, 0.35
MARGIN, CLUSTER_RATIO, COVERAGE, TOC_SIMILARITY = 0.10, 0.88, 0.4, 0.85
MIN_NATIVE_CHARS, MIN_QUALITY, LOW_CONFIDENCE = 40, 0.60, 0.80
MAX_FILE_MB, MAX_PAGES, MAX_UNZIPPED_MB = 25, 300, 300
