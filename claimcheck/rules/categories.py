"""Article category rules: ordered families of line suffixes, as data."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass


@dataclass(frozen=True)
class ClassRule:
    """A category and the line endings (or inner words) that announce it."""

    category: str
    endings: tuple[str, ...]
    inner: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for field in ("endings", "inner"):
            words = tuple(unicodedata.normalize("NFC", w) for w in getattr(self, field))
            object.__setattr__(self, field, words)


@dataclass(frozen=True)
class CategoryPack:
    """Families are independent; inside a family the first matching rule of a line wins."""

    name: str
    families: tuple[tuple[ClassRule, ...], ...]
    sentence_ends: tuple[str, ...]
    intro_place_cues: tuple[str, ...]
    people_fallback: str = "other_people"
    place_fallback: str = "other_places"
    default: str = "other"

    @property
    def order(self) -> tuple[str, ...]:
        return tuple(rule.category for family in self.families for rule in family)

    @property
    def people(self) -> tuple[str, ...]:
        return tuple(rule.category for rule in self.families[0])

    @property
    def places(self) -> tuple[str, ...]:
        return tuple(rule.category for rule in self.families[1])


# --- fixed values: Bengali category endings ----------------------------------------
# Two published endings carry foreign letters and can never match; they are spelt
# out correctly here (the philosopher and the bank entries).
BENGALI = CategoryPack(
    name="bengali",
    sentence_ends=("।", ".", "?"),
    intro_place_cues=("অবস্থিত", "স্থানাঙ্ক"),
    families=(
        (
            ClassRule("writers_poets", ("কবি", "লেখক", "ঔপন্যাসিক", "প্রাবন্ধিক", "অনুবাদক")),
            ClassRule(
                "politicians_leaders",
                (
                    "রাজনীতিবিদ",
                    "নেতা",
                    "শাসক",
                    "সম্রাট",
                    "সুলতান",
                    "খলিফা",
                    "রাজা",
                    "প্রেসিডেন্ট",
                    "প্রধানমন্ত্রী",
                    "মন্ত্রী",
                ),
            ),
            ClassRule(
                "scientists_scholars",
                (
                    "বিজ্ঞানী",
                    "গবেষক",
                    "অধ্যাপক",
                    "দার্শনিক",
                    "সমাজবিজ্ঞানী",
                    "ইতিহাসবিদ",
                    "ভাষাবিদ",
                ),
            ),
            ClassRule(
                "artists_performers",
                (
                    "অভিনেতা",
                    "অভিনেত্রী",
                    "সঙ্গীতশিল্পী",
                    "গায়ক",
                    "চিত্রশিল্পী",
                    "নর্তক",
                    "সুরকার",
                    "গীতিকার",
                    "চলচ্চিত্র নির্মাতা",
                ),
            ),
            ClassRule("athletes", ("খেলোয়াড়", "ক্রিকেটার", "ফুটবলার", "অ্যাথলেট", "দাবাড়ু")),
            ClassRule(
                "other_people",
                ("ব্যক্তি", "ব্যক্তিত্ব", "মহিলা", "নারী", "পুরুষ"),
                inner=("জন্ম", "মৃত্যু", "জীবনী"),
            ),
        ),
        (
            ClassRule("countries_states", ("দেশ", "রাষ্ট্র", "রাজ্য", "প্রদেশ")),
            ClassRule("cities_towns", ("শহর", "নগর", "রাজধানী", "পৌরসভা")),
            ClassRule(
                "administrative_units",
                ("বিভাগ", "জেলা", "উপজেলা", "ইউনিয়ন", "থানা", "ওয়ার্ড", "প্রশাসনিক এলাকা"),
            ),
            ClassRule("villages", ("গ্রাম",)),
            ClassRule(
                "water_bodies",
                ("নদী", "সাগর", "মহাসাগর", "হ্রদ", "খাল", "বিল", "ঝরনা", "উপসাগর", "জলাশয়"),
            ),
            ClassRule(
                "mountains_islands",
                ("পাহাড়", "পর্বত", "দ্বীপ", "উপদ্বীপ", "গিরিপথ", "পর্বতমালা"),
            ),
            ClassRule(
                "other_places",
                ("জনবহুল স্থান", "ভৌগোলিক স্থান", "ঐতিহাসিক স্থান", "স্থান", "অঞ্চল"),
            ),
        ),
        (
            ClassRule("wars_battles", ("যুদ্ধ", "সামরিক অভিযান", "যুদ্ধবিগ্রহ")),
            ClassRule(
                "historical_events_revolutions",
                ("আন্দোলন", "বিপ্লব", "দাঙ্গা", "চুক্তি", "ঘটনা", "ইতিহাস"),
            ),
        ),
        (
            ClassRule("books_literature", ("উপন্যাস", "কবিতা", "গ্রন্থ", "সাহিত্য", "গল্প", "বই")),
            ClassRule("movies_drama", ("চলচ্চিত্র", "নাটক", "থিয়েটার", "টেলিভিশন অনুষ্ঠান")),
            ClassRule("music_songs", ("গান", "সঙ্গীত", "বাদ্যযন্ত্র", "অ্যালবাম")),
            ClassRule(
                "art_festivals", ("চিত্রকর্ম", "ভাস্কর্য", "মেলা", "উৎসব", "ঐতিহ্য", "শিল্প")
            ),
        ),
        (
            ClassRule(
                "educational_institutions",
                ("বিশ্ববিদ্যালয়", "কলেজ", "বিদ্যালয়", "একাডেমি", "শিক্ষা প্রতিষ্ঠান"),
            ),
            ClassRule(
                "companies_businesses",
                ("কোম্পানি", "ব্যাংক", "কারখানা", "কর্পোরেশন", "ব্যবসায়িক প্রতিষ্ঠান"),
            ),
            ClassRule("government_bodies", ("সংসদ", "মন্ত্রণালয়", "বিভাগ", "আদালত", "সরকার")),
            ClassRule("clubs_associations", ("ক্লাব", "দল", "সংগঠন", "সংস্থা", "সমিতি")),
        ),
        (
            ClassRule("religious_texts_doctrines", ("মতবাদ", "ধর্মগ্রন্থ", "পুরাণ", "ধর্মবিশ্বাস")),
            ClassRule(
                "deities_figures", ("দেবতা", "দেবী", "পয়গম্বর", "অবতার", "ধর্মীয় ব্যক্তিত্ব")
            ),
            ClassRule(
                "religious_places", ("মন্দির", "মসজিদ", "গির্জা", "বিহার", "ধর্মীয় স্থান")
            ),
        ),
        (
            ClassRule("animals", ("প্রাণী", "পাখি", "মাছ", "পতঙ্গ", "স্তন্যপায়ী", "সরীসৃপ")),
            ClassRule("plants", ("উদ্ভিদ", "ফুল", "গাছ", "ফল", "বৃক্ষ")),
        ),
        (
            ClassRule("mathematics", ("গণিত", "জ্যামিতি", "বীজগণিত")),
            ClassRule("physics_chemistry", ("পদার্থবিজ্ঞান", "রসায়ন")),
            ClassRule(
                "astronomy_space", ("জ্যোতির্বিজ্ঞান", "মহাকাশ", "গ্রহ", "তারা", "নক্ষত্র")
            ),
            ClassRule(
                "technology_computing",
                ("প্রযুক্তি", "কম্পিউটার", "সফটওয়্যার", "ইন্টারনেট", "মোবাইল"),
            ),
            ClassRule("medicine_biology", ("চিকিৎসা", "জীববিজ্ঞান", "রোগ", "ঔষধ")),
        ),
    ),
)

# Title and category words that mark an English page as related to the region.
REGION_KEYWORDS = (
    "bangladesh",
    "bangladeshi",
    "bengal",
    "bengali",
    "dhaka",
    "chittagong",
    "sylhet",
    "rajshahi",
    "khulna",
    "barisal",
    "mymensingh",
    "rangpur",
    "comilla",
    "east pakistan",
    "east bengal",
)
# --- end of fixed values --------------------------------------------------------------

# Endings that occur in the link lists of the shipped test pages.
TABLE_DEMO = CategoryPack(
    name="table_demo",
    sentence_ends=(".", "?"),
    intro_place_cues=("ouest", "ciónmente"),
    families=(
        (
            ClassRule("writers_poets", ("ble", "eau")),
            ClassRule("scientists_scholars", ("ung", "heit")),
            ClassRule("other_people", ("nd",), inner=("thin", "ver")),
        ),
        (
            ClassRule("countries_states", ("tion", "ción")),
            ClassRule("cities_towns", ("ing", "lich")),
            ClassRule("other_places", ("est", "aux")),
        ),
        (ClassRule("wars_battles", ("sh",)), ClassRule("historical_events_revolutions", ("ou",))),
        (ClassRule("books_literature", ("er", "que")), ClassRule("movies_drama", ("en", "elle"))),
        (ClassRule("companies_businesses", ("and", "und")),),
        (ClassRule("deities_figures", ("the", "der")),),
        (ClassRule("animals", ("at",)), ClassRule("plants", ("ch", "ado"))),
        (ClassRule("mathematics", ("ti",)), ClassRule("technology_computing", ("ly", "ment"))),
    ),
)
