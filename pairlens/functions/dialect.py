"""What differs between the languages of the paired conditions."""

from __future__ import annotations

from dataclasses import dataclass, field

# fixed values: code point ranges of marks, the word run of the postfix order, white space
HEBREW_MARKS = r"\x{0591}-\x{05AF}\x{05B0}-\x{05C7}"
ARABIC_MARKS = r"\x{064B}-\x{0652}\x{0670}"
POSTFIX_MARKS = r"\x{064B}-\x{065F}\x{0670}"
POSTFIX_RUN = r"\x{0621}-\x{063A}\x{0640}-\x{065F}\x{0670}"
WHITE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# fixed values: Arabic stop words
STOP_WORDS = (
    "في", "من", "إلى", "على", "عن", "مع", "هو", "هي", "هم", "هن",
    "أن", "إن", "كان", "كانت", "التي", "الذي", "الذين", "وهو", "وهي",
    "هذا", "هذه", "ذلك", "تلك", "قد", "لا", "ما", "لم", "لن",
    "أو", "ثم", "حتى", "إذا", "بعد", "قبل", "كل", "بين",
)

# fixed values: prompts for a model, with and without a passage
HEBREW_EXTRACTIVE = "קרא את הקטע הבא וענה על השאלה. כתוב את התשובה בדיוק כפי שהיא מופיעה בקטע, ללא הסבר נוסף.\n\nקטע: {context}\n\nשאלה: {question}\n\nתשובה:"
HEBREW_OPEN = "ענה על השאלה הבאה בקצרה. כתוב רק את התשובה.\n\nשאלה: {question}\n\nתשובה:"
ARABIC_EXTRACTIVE = "اقرأ النص التالي وأجب على السؤال. اكتب الإجابة كما وردت في النص بالضبط، دون أي شرح إضافي.\n\nالنص: {context}\n\nالسؤال: {question}\n\nالإجابة:"
ARABIC_OPEN = "أجب على السؤال التالي باختصار. اكتب الإجابة فقط.\n\nالسؤال: {question}\n\nالإجابة:"
# fixed values: messages for a judge
JUDGE = "Question: {question}\n\nGold answer(s): {gold_answers}\n\nCandidate answer: {prediction}"
JUDGE_WITH_CONTEXT = "Question: {question}\n\nContext: {context}\n\nGold answer(s): {gold_answers}\n\nCandidate answer: {prediction}"


@dataclass(frozen=True)
class Dialect:
    name: str
    marks: str
    plain: str
    marked: str
    extractive: str
    open_domain: str
    stop_words: tuple[str, ...] = ()
    lower_last: bool = False
    answer_types: tuple[str, ...] = ("entity", "short_phrase", "value")
    pilot_cell: int = 5
    pilot_levels: dict[str, int] = field(default_factory=dict, hash=False)
    targets: dict[str, int] = field(default_factory=dict, hash=False)


# fixed values: pilot quotas of the levels of F1, and target sizes of the sources
HEBREW = Dialect(
    "hebrew", HEBREW_MARKS, "no_niqud", "with_niqud", HEBREW_EXTRACTIVE, HEBREW_OPEN, pilot_cell=7, pilot_levels={"high": 3, "mid": 1, "low": 3},
    targets={"heq": 600, "parashoot": 500, "mkqa": 400},
)
ARABIC = Dialect(
    "arabic", ARABIC_MARKS, "no_tashkeel", "with_tashkeel", ARABIC_EXTRACTIVE, ARABIC_OPEN, stop_words=STOP_WORDS, lower_last=True, answer_types=("entity", "short_phrase", "value", "number_with_unit"),
    pilot_cell=5, pilot_levels={"high": 2, "mid": 1, "low": 2}, targets={"arcd": 500, "tydiqa": 600, "mkqa": 400},
)
