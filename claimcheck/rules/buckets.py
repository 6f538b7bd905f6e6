"""Bucket names of the corpus-sort job."""

# --- fixed values ---------------------------------------------------------------
BUCKETS = ("wiki", "idioms", "literal", "grammar", "skip")

# Order matters: the substring fallback takes the first alias that occurs.
ALIASES = {
    "famous": "wiki",
    "famous-bn": "wiki",
    "famous_bn": "wiki",
    "idiom": "idioms",
    "idioms": "idioms",
    "literal": "literal",
    "grammar": "grammar",
    "wiki": "wiki",
    "wikipedia": "wiki",
    "skip": "skip",
    "discard": "skip",
    "none": "skip",
}

TEXT_KEYS = ("text", "passage", "content")

SORT_PROMPT = (
    "You are an expert data cleaner and annotator. Your goal is to convert the input text into a list of clean, sorted, atomic, and self-contained factual statements (primarily in Bengali, but you may keep or translate English sentences that contain valid facts), and classify them into their correct category.\n\n"
    "Instructions for Rewording:\n"
    "1. Resolve Pronouns & Context: Replace vague words (e.g., 'তিনি', 'ওনার', 'এটি', 'সেখানে') with the actual names, entities, or concepts they refer to. Every generated fact must be fully understandable on its own without needing external context.\n"
    "2. Prepend Story/Book Context: If the text is from a story, book, or poem (like 'তোতা-কাহিনি' or 'রবীন্দ্রনাথ ঠাকুরের কবিতা'), explicitly add this context to the fact (e.g., 'রবীন্দ্রনাথ ঠাকুরের তোতা-কাহিনি গল্পে রাজা পাখিটিকে শিক্ষা দেওয়ার নির্দেশ দেন।').\n"
    "3. Convert Questions/Blanks: Turn questions (e.g., 'পদ্মা নদীর শাখা নদী কোনটি?') and fill-in-the-blanks (e.g., 'বাংলাদেশ ______ সালে অলিম্পিকে অংশ নেয়') into direct, declarative facts (e.g., 'পদ্মা নদীর শাখা নদী হলো গড়াই ও ধলেশ্বরী।' or 'বাংলাদেশ ১৯৮৪ সালে অলিম্পিকে অংশগ্রহণ করে।').\n"
    "4. Handle Long/Messy Paragraphs: If the input is a long article or contains multiple paragraphs, extract all key factual statements (up to 5-10 facts). Split them so each fact is a single, short, atomic sentence.\n"
    "5. Output Format: Return a list of reworded facts, with one fact per line prefixed by a dash (-). If it is a clean single fact, output just that one fact. If the category is skip, do not reword anything (leave the reworded section empty).\n\n"
    "Categories:\n"
    "- wiki: General facts (science, global history/geography, global events), Bangladesh history, Bangla literature, Bangladeshi geography, famous Bengali personalities/events, and Bengali literary stories (e.g. তোতা-কাহিনি)\n"
    "- idioms: Bengali idioms, proverbs, or figurative meanings (ভাবার্থ, বাগধারা)\n"
    "- literal: Word translation or literal meanings (শাব্দিক অর্থ, আক্ষরিক অর্থ)\n"
    "- grammar: Bangla grammar rules, definitions, and grammatical examples (সমাস, সন্ধি, কারক)\n"
    "- skip: Pure math problems/equations/number-puzzles (do NOT skip facts that just contain dates, years, or quantities), questions or fill-in-the-blanks that do not provide an answer/cannot be resolved to a fact, programming code, and noisy/unreadable/low-quality text (do NOT skip English sentences if they express a valid fact; classify them to their correct category instead)\n\n"
    "Output Format:\n"
    "bucket: <category>\n"
    "reworded:\n"
    "- <Factual Sentence 1> (leave empty if bucket is skip)\n"
    "- <Factual Sentence 2> (if multiple)\n\n"
    "Input Text: {text}\n"
)
# --- end of fixed values ----------------------------------------------------------
