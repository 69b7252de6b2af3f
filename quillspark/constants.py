"""Fixed values that results depend on, and defaults that callers may replace."""

# Keywords matched as exact substrings (zh).
KEYWORDS_ZH = (
    "解放军", "人民解放军", "军委", "中央军委", "国防部", "战区",
    "海军", "空军", "火箭军", "陆军", "战略支援部队", "联合参谋部",
    "海警", "武警", "人民武装警察",
    "导弹", "航母", "舰", "潜艇", "歼", "轰", "运", "直", "无人机",
    "高超音速", "核", "弹道导弹", "巡航导弹",
    "演习", "军演", "实弹", "联合作战", "战备", "巡逻", "侦察",
    "台湾", "台海", "南海", "东海", "钓鱼岛", "黄岩岛", "渤海",
    "国防工业", "装备", "采购", "研制", "航空工业", "中船集团",
    "兵器工业", "航天科工", "航天科技",
    "信息化", "智能化", "网络战", "信息战", "认知战", "心理战",
    "电子战", "太空", "网络空间",
    "新疆", "西藏", "香港", "反恐", "维稳",
    "军事委员会", "政治工作", "习近平主席", "国防",
)

# Keywords matched as substrings in any case (en).
KEYWORDS_EN = (
    "PLA", "People's Liberation Army", "CMC", "Central Military Commission",
    "Ministry of National Defense", "MND",
    "People's Armed Police", "PAP", "China Coast Guard",
    "PLAN", "PLAAF", "PLARF", "PLASSF", "PLA Navy", "PLA Air Force",
    "PLA Rocket Force",
    "military exercise", "live-fire", "joint exercise", "patrol", "drill",
    "deployment", "readiness",
    "aircraft carrier", "destroyer", "submarine", "fighter jet", "bomber",
    "missile", "hypersonic", "nuclear", "ballistic", "cruise missile",
    "drone", "UAV",
    "Taiwan", "South China Sea", "East China Sea", "Senkaku", "Diaoyu",
    "Scarborough", "Spratlys", "Paracels",
    "defense industry", "AVIC", "CSSC", "procurement", "weapons system",
    "cyber", "information warfare", "cognitive warfare", "electronic warfare",
    "space", "counterspace",
    "defense", "military",
)

# Categories in order of priority (1 first) with their labels.
CATEGORY_LABELS = {
    "taiwan": "Taiwan",
    "south_china_sea": "South China Sea",
    "east_china_sea": "East China Sea",
    "us_china_military": "U.S.–China Military",
    "nuclear": "Nuclear",
    "exercises": "Exercises",
    "modernization": "Modernization",
    "coast_guard": "Coast Guard",
    "military_diplomacy": "Military Diplomacy",
    "doctrine": "Doctrine",
    "cyber_info": "Cyber & Info",
    "political_work": "Political Work",
    "personnel": "Personnel",
    "internal_security": "Internal Security",
}
CATEGORY_PRIORITY = {slug: i + 1 for i, slug in enumerate(CATEGORY_LABELS)}
NO_PRIORITY = 99

# Priority of a URL's section among copies of one article.
SECTION_PRIORITY = {
    "yw_208727": 100,
    "bz_208549": 90, "hj_208557": 90, "kj_208559": 90, "hjj_208561": 90,
    "wj_208567": 85,
    "jw_208551": 80, "zq_208553": 80,
    "fyr": 50,
}
OTHER_SECTION, NO_SECTION = 70, 50

# Phrases of a summary that tell of failed extraction.
EXTRACTION_SIGNALS = (
    "does not match",
    "body does not match",
    "cannot be meaningfully analyzed",
    "mismatch between headline",
    "insufficient substantive content",
    "visible text does not",
)

# What the summary linter looks for.
BANNED_OPENERS = (
    "the article discusses", "the article reports", "the report highlights", "the piece discusses",
    "this article", "this development underscores", "in today's",
)
BANNED_PHRASES = (
    "underscores the importance", "in today's complex geopolitical landscape", "it is important to note",
    "game-changing", "unprecedented", "historic milestone", "comprehensive capabilities",
)
CRUTCHES = ("this signals", "it signals", "this reflects continued")
BANNED_TRANSITIONS = ("moreover", "furthermore", "additionally", "ultimately")
MAX_SENTENCES, MAX_WORDS, EXCERPT = 3, 100, 300

# Fields of an edition.
REQUIRED_FIELDS = (
    "title", "dek", "opening_note", "what_stood_out", "why_it_matters",
    "what_was_routine", "term_to_know_term", "term_to_know_explanation",
    "what_im_watching_next", "edition_type",
)
PROSE_FIELDS = (
    "title", "dek", "signal", "opening_note", "what_stood_out",
    "why_it_matters", "what_was_routine", "term_to_know_explanation",
    "what_im_watching_next",
)

# Licences of images, in lower case.
ALLOWED_LICENSES = (
    "public domain", "cc0", "cc-zero",
    "cc by 1.0", "cc by 2.0", "cc by 2.5", "cc by 3.0", "cc by 4.0",
    "cc-by-1.0", "cc-by-2.0", "cc-by-2.5", "cc-by-3.0", "cc-by-4.0",
    "cc by-sa 1.0", "cc by-sa 2.0", "cc by-sa 2.5", "cc by-sa 3.0", "cc by-sa 4.0",
    "cc-by-sa-1.0", "cc-by-sa-2.0", "cc-by-sa-2.5", "cc-by-sa-3.0", "cc-by-sa-4.0",
)
REJECTED_LICENSE_WORDS = ("nc", "nd")
REJECTED_LICENSES = ("non-commercial", "noderivative", "no derivative", "all rights reserved", "editorial", "fair use", "unknown")

# Words that tokens drop.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "for", "to", "in", "on",
    "at", "is", "are", "was", "were", "be", "with", "from", "as", "by",
    "that", "this", "these", "those", "it", "its", "into", "over", "after", "before",
    "but", "than", "their", "they", "them", "we", "our", "us", "you", "your",
    "i", "my", "me", "he", "she", "his", "her", "him", "not", "no",
    "do", "does", "did", "have", "has", "had", "what", "which", "who", "whom",
    "whose", "when", "where", "why", "how", "very", "more", "most", "less", "least",
)
SENSATIONAL = (
    "war", "wars", "warfare", "missile", "missiles", "invasion", "invade", "explosion", "explosions", "blood",
    "casualty", "casualties", "attack", "attacks", "strike", "strikes",
)

# Defaults of the schedule and the gate.
CAPACITY, RESERVE, LIVE_DAYS, THRESHOLD = 55, 0.3, 14, 0.60
TRAIL_CAP = 13
# Dollars for a million tokens read and written, by kind of model: only a default, callers give their own table.
PRICES = {"small": (1.00, 5.00), "large": (3.00, 15.00)}
OUTPUT_RATIO = 1.3
