# Fixed values.  Results depend on these exact strings, so they are listed as
# plain text, in the order in which they apply.

# Decorative symbols deleted from harvested text.
DECORATIVE_SYMBOLS = (
    "§№☆★○●◎◇◆□■△▲※→←↑↓〓＃＆＠＼＾＿￣―♂♀‘’々～‖＂〃〔〕〈〉《》「」『』〖〗【】（）［｛｝°＄￡￥‰％℃¤￠"
)

# ASCII symbols deleted right after the decorative ones.
ASCII_SYMBOLS = "~@#$%^*()_=-+[]"

# Elements deleted together with their content.
BLOCK_ELEMENTS = ["script", "a"]

# Bare tags (without attributes) deleted, one after the other.
BARE_TAGS = ["table", "tr", "div", "td", "span", "font", "p", "cc"]

# Lead-in of a synopsis.
SYNOPSIS_LEAD = r"<strong>.*?简单介绍:</strong>"

# Web address prefixes, then site names.  The last bracket is a character
# class, on purpose.
URL_PREFIXES = ["http://", "https://"]
SITE_NAME = r"[\\\w\./。]{3,20}\.[com|net|org|cn|co|info|us|cc|xxx|tv|ws|hk|tw]+"
# A site name is there if a dot has three name characters before and one of the
# class after it.
SITE_NAME_TEST = r"\.[com|net|org|cn|co|info|us|cc|xxx|tv|ws|hk|tw](?<=[\\\w\./。]{3}\..)"

# Numerals that may number a chapter.
CHAPTER_DIGITS = "[0123456789一二三四五六七八九〇壹贰叁肆伍陆柒捌玖零十百千万亿]"

# Chapter title shapes; the first that matches wins.
CHAPTER_SHAPES = [
    f"第{CHAPTER_DIGITS}+章-第{CHAPTER_DIGITS}+章",
    rf"【第{CHAPTER_DIGITS}+章】\s+.*",
    rf"第{CHAPTER_DIGITS}+章\s+.*",
    f"第{CHAPTER_DIGITS}+章",
    "第?[0123456789]+[-]{1}[0123456789]+章?",
    "第?[0123456789]+章?",
    r"[0123456789]+[\.\s]+.*",
    ".*?后记.*",
    ".*?大结局.*",
]

# Pleas and notes trimmed from a chapter title, in order.
CHAPTER_TRIMS = [
    r"【[紧急\!！]+】",
    r"【[呼救人啊\!！]+】",
    r"【[\!！]+】",
    r"【[\.]+】",
    "【.*[求粉丝月票订阅]+.*】",
    r"\([^上中下]*?\)",
]

# Media links inside a decoded source file.
MEDIA_LINK = r"((bdhd://)|(qvod://)).*?((.rmvb)|(.rm)|(.avi)|(.mp4)|(.asf)|(.wmv))+"
MEDIA_EXTENSIONS = [".rmvb", ".rm", ".avi", ".mp4", ".asf", ".wmv"]
MEDIA_DOMAIN = r"[a-zA-Z0-9\.]+\.(com|net|org|co|cn|us|hk|info|gov)"
BAIDU_SCHEME = "bdhd"
BAIDU = "baidu"
QVOD = "qvod"

# Parts of a series title / file name that say nothing about the episode.
SERIES_TITLE_NOISE = ["(", ")", "国语", "粤语", "版"]
EPISODE_NOISE_EXTRA = ["[", "]", "(", ")", "国语", "粤语", "dvd", "bd", "版", "-"]

# Defaults.
DEFAULT_CLASS = "其他"
DEFAULT_YEAR = "2012"
DEFAULT_EPISODE = "全集"
ONGOING_STATUS = "连载中"
BOOK_MODEL_ID = 4
SERIES_MODEL_ID = 6
COVER_PATH = "/u/MovieFace/%d.jpg"
BOOK_COVER_PATH = "e/api/xmlrpc.aspx?a=savebookface&id="
EPISODE_NUMBER = "第%s集"
MAX_TRIES = 3
