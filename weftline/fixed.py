"""Tables that results depend on."""

from __future__ import annotations

# --- fixed values: host rule -> provider, first match wins; a rule that ends in a dot is a name under any top-level domain
PROVIDERS = [
    ("pan.baidu.com", "baidu"), ("yun.baidu.com", "baidu"), ("eyun.baidu.com", "baidu"), ("pan.quark.cn", "quark"),
    ("alipan.com", "aliyun"), ("aliyundrive.com", "aliyun"), ("115cdn.com", "115"), ("115.com", "115"), ("anxia.com", "115"),
    ("pan.xunlei.com", "xunlei"), ("cloud.189.cn", "tianyi"), ("123pan.com", "123"), ("123912.com", "123"), ("123684.com", "123"),
    ("123865.com", "123"), ("drive.uc.cn", "uc"), ("mypikpak.com", "pikpak"), ("pikpak.me", "pikpak"), ("arxiv.org", "direct"),
    ("doi.org", "direct"), ("openalex.org", "direct"), ("crossref.org", "direct"), ("mangadex.org", "direct"), ("gutenberg.org", "direct"),
    ("standardebooks.org", "direct"), ("openlibrary.org", "direct"), ("libgen.", "direct"), ("sci-hub.", "direct"),
]
SHARE_PROVIDERS = ["baidu", "quark", "aliyun", "xunlei", "tianyi", "uc", "123", "115", "pikpak"]
PRIORITY = ["baidu", "quark", "aliyun", "115", "xunlei", "tianyi", "123", "uc", "pikpak", "magnet"]

# --- fixed values: statuses (weight, tier, bucket, alive, dead), kinds' weights, and the constants of scoring
STATUSES = [
    ("alive", 1.0, 0, "alive", True, False), ("need_pwd", 0.8, 1, "alive", True, False), ("wrong_pwd", 0.5, 1, "wrong_pwd", True, False),
    ("unchecked", 0.6, 2, "unchecked", False, False), ("unsupported", 0.6, 2, "unsupported", False, False),
    ("unknown", 0.3, 2, "unknown", False, False), ("dead", 0.02, 2, "dead", False, True), ("not_found", 0.0, 2, "dead", False, True),
]
KIND_WEIGHTS = {"api": 0.95, "tg": 0.9, "bilibili": 0.8, "forum": 0.8, "websearch": 0.6, "bt": 0.55, "aggregator": 1.0}
KIND_DEFAULT, STATUS_DEFAULT = 0.6, 0.5
SOURCE_BONUS, SOURCE_CAP, RRF_K, RRF_CAP = 0.12, 0.35, 60, 0.30
HALF_LIFE_DAYS, FRESH_FLOOR, PRIORITY_BONUS, CODE_BONUS = 730, 0.35, 1.25, 1.1
RELAXED_PENALTY, RELEVANCE_POWER, HIGH, MIDDLE = 0.5, 2.0, 0.85, 0.45
TTL_HOURS, DEAD_TTL_HOURS, BUDGET, EARLY_SHARE, DISABLE_AFTER = 6, 720, 150, 0.75, 6
CODE_WINDOW, LEFT_PENALTY = 120, 20

# --- fixed values: answer codes of providers -> status
BAIDU_LIVENESS = {"0": "alive", "-9": "need_pwd", "-21": "need_pwd", "140": "not_found", "-3": "dead"}
BAIDU_CODE = {"0": "alive", "-9": "wrong_pwd", "-12": "wrong_pwd", "105": "not_found", "-62": "unknown"}
QUARK_CODE = {"0": "alive", "41006": "not_found"}
ALIYUN_CODE = {"NotFound.ShareLink": "not_found", "ShareLink.Cancelled": "dead", "ShareLink.Expired": "dead", "ShareLinkExpired": "dead"}
ALIYUN_CONTAINS = {"NotFound": "not_found", "Cancelled": "dead", "Expired": "dead"}
P115_CODE = {"0": "alive", "4100012": "need_pwd", "4100008": "wrong_pwd", "990002": "not_found"}
TIANYI_XML = {"ShareInfoNotFound": "not_found", "ShareInfoInvalid": "dead"}

# --- fixed values: patterns (bodies of character classes and regexes that Python and Java both read)
#: What separates the words of a query, and may stand between the characters of a CJK name.
SEPARATORS = r"\s,，、/|·:：;；!！?？.。…—–～~()（）\[\]【】{}｛｝<>《》〈〉「」『』“”‘’\"'`^_-"
#: Characters that aren't seen.
INVISIBLE = r"\u00ad\u180e\u200b-\u200f\u2028\u2029\u202a-\u202e\u2060-\u2064\ufeff"
#: What may stand between a name and its number.
NUMBER_GAP = r"[\s:：._-]*"
#: A season at the end of a name.
SEASON = r"(?:第[一二三四五六七八九十百\d]+季|s\d{1,2})"
#: A keyword and the code of four characters after it; a code alone in brackets.
CODE = r"(?:pwd|passwd|password|passcode|code|提取码|提取碼|访问码|訪問碼|提取密码|訪問密碼|访问密码|密码|密碼)\s*(?:是|为|：|:|＝|=)?\s*[「『\"'（(【\[]?\s*([A-Za-z0-9]{4})(?![A-Za-z0-9_])"
BARE_CODE = r"[（(【\[]\s*([A-Za-z0-9]{4})\s*[）)】\]]"
#: Characters at which a link ends, and those cut from its end.
LINK_STOP = r"\s\"'<>()（）【】「」『』《》，,、。；;：:！!？?\]\[{}|\\^`一-鿿㐀-䶿　-〿＀-￯"
LINK_TAIL = "。，、；;!！?？'\""
#: A magnet link, whose parameters go on to a character at which it ends.
MAGNET = r"magnet:\?xt=urn:btih:[A-Za-z0-9]{32,40}(?:&[^\s\"'<>()（）【】「」『』《》，,、。；;\]\[]+)*"

# --- fixed values: characters that don't stand before a bare link, and those cut from the ends of the title before one
NOT_BEFORE_BARE = r"\w.@/-"
TITLE_ENDS = " \t\n:：-—|｜·,，、"

# --- fixed values: words before a link that don't say what it leads to: of codes, in either script; of providers and invitations; Latin ones
CODE_WORDS, CODE_WORDS_LATIN = "提取码 密码 访问码".split(), "pwd code".split()
FILLER_WORDS = """百度网盘 百度云 百度 夸克网盘 夸克 阿里云盘 阿里 迅雷云盘 迅雷 天翼云盘 天翼 移动云盘 123云盘 123网盘 115网盘 uc网盘
磁力链接 磁力 网盘 云盘 链接 地址 下载 提取码 密码 访问码 分享 资源 备用 点击 打开 复制""".split()
FILLER_WORDS_LATIN = "uc pikpak pwd code link download".split()

# --- fixed values: words of queries
QUALIFIERS = """4k 8k 2160p 1080p 720p hd hdr hdr10 dv 杜比 dolby atmos 全景声 高码 高码率 remux 原盘 蓝光 bluray webrip webdl bdrip hdtv
中字 中文字幕 字幕 国语 粤语 双语 简中 繁中 内嵌 全集 完整版 完结 未删减 导演剪辑版 加长版 高清 超清 无损 hires hi-res 母带 原抓 整轨 分轨
pdf epub mobi azw3 txt flac wav ape dsd mp3 mp4 mkv iso 电子书""".split()
GENERIC = """破解 破解版 激活 激活版 注册机 绿色版 便携版 免安装 免安装版 安装包 安装 安装版 硬盘版 下载 下载版 在线 观看 播放 免费 免费版 分享 整理 更新 最新
网盘 云盘 百度 百度网盘 夸克 阿里云盘 115 迅雷 天翼 磁力 链接 提取码 密码 资源 合集 整合包 教程 教学 网课 课程 视频 音频 软件 版本 版 中文 中文版 汉化 汉化版
官方 官方版 正式版 旗舰版 专业版 高清版 手机版 电脑版 安卓版 零基础 入门 初级 中级 高级 进阶 基础 自学 全套 从零 系统 教材 讲义 课件 真题 题库 笔记 资料 习题 答案 考点 精讲""".split()
PEELABLE_TOO = "全集 完整版 完结 未删减 导演剪辑版 加长版 蓝光 原盘 中字 中文字幕 字幕 电子书 高清 超清".split()
CATEGORIES = """电影 电视剧 剧集 专辑 歌曲 漫画 合成器 音源 小说 论文 作品集 素材 素材包 模型 插件 预设 preset 修复版 最终季 剧场版 三部曲 纯音乐""".split()
FILLER_TITLES = "文件 文件夹 未命名 download untitled".split()

# --- fixed values: vertical -> keywords
VERTICALS = {
    "movie": "电影 影片 蓝光 原盘 remux bdrip web-dl webdl 1080p 2160p 4k hdr 杜比 dolby atmos 美剧 英剧 韩剧 日剧 剧集 连续剧 电视剧 纪录片 综艺 movie film".split(),
    "anime": "动漫 番剧 新番 漫画 同人 ova tva anime manga 轻小说 galgame 里番 剧场版".split(),
    "music": "音乐 专辑 无损 flac wav ape dsd hires 歌曲 单曲 ost 原声 歌单 演唱会 专辑下载 music album hi-res mora".split(),
    "ebook": "电子书 小说 图书 书籍 教程书 pdf epub mobi azw3 txt ebook 杂志 期刊下载 书单 阅读".split(),
    "course": "教程 课程 网课 培训 教学 视频教程 公开课 训练营 课件 讲义 course tutorial lecture".split(),
    "software": "软件 破解 激活 注册机 绿色版 便携版 免安装 office adobe photoshop windows mac 工具 效率 app 工具包".split(),
    "audio-tool": [
        "vst", "vst3", "音源", "合成器", "采样", "kontakt", "serum", "omnisphere", "宿主", "daw", "cubase", "fl studio", "ableton", "logic", "插件", "混音", "母带",
        "效果器", "preset", "音色", "soundbank", "大气合成器",
    ],
    "game": "游戏 steam switch ps5 ps4 xbox 汉化 免安装 模拟器 rom 单机 手游 游戏下载 game repack".split(),
    "design": [
        "素材", "模板", "psd", "笔刷", "字体", "设计", "ui", "icon", "mockup", "预设", "调色", "ae 模板", "pr 模板", "素材包",
    ],
    "academic": [
        "论文", "文献", "sci", "sci-hub", "期刊", "arxiv", "知网", "万方", "学位", "考研资料", "paper", "journal", "research", "preprint", "thesis", "dissertation",
        "citation", "doi", "study", "scholar", "physics", "chemistry", "biology", "mathematics", "machine learning", "neural", "quantum",
        "algorithm",
    ],
    "comic": "漫画 条漫 汉化组 comic cbr cbz manga manhwa manhua webtoon doujin".split(),
}
# --- fixed values: name -> other names that a search also asks for
ALIASES = {"大气合成器": ["Omnisphere"], "血清": ["Serum"], "血清合成器": ["Serum"], "康泰克": ["Kontakt"], "水果": ["FL Studio"], "酷贝斯": ["Cubase"], "臭氧": ["iZotope Ozone"]}
# --- fixed values: parts of paths that aren't content
SKIP_PATHS = ["/tag/", "/tags/", "/category/", "/page/", "/login", "/register", "/search", "/user/", "/about", "/contact", "/feed"]
# --- fixed values: parts of paths that a probe of a site doesn't take for results
NO_RESULT_PATHS = """/static/ /assets/ /css/ /js/ /img/ /images/ /uploads/ /templates/ /fonts/ /media/
/wp-content/ /wp-includes/ /wp-json /wp-admin /wp-login /xmlrpc /comments /category/ /tag/ /author/ /page/ /feed /rss /sitemap
/about /contact /privacy /terms /dmca /disclaimer /login /register/ /logout /search /user/ /member/ /cart /checkout /my-account /faq /help
/plugin/ /plugins/ /template/ /themes/ /engine/""".split()
# --- fixed values: URLs that sites search under, after their base; and words that a site of each kind should find
SEARCH_PATTERNS = """/?s={q} /search?q={q} /search?keyword={q} /search?wd={q} /search?word={q} /search/?q={q} /search/{q} /so/{q} /index.php?search={q} /?keyword={q}
/search.php?mod=forum&srchtxt={q} /search.php?keyword={q} /e/search/?searchget=1&tbname=news&keyboard={q}
/index.php?do=search&subaction=search&story={q} /?do=search&subaction=search&story={q}
/vodsearch/-------------.html?wd={q} /index.php/vod/search.html?wd={q} /index.php/vod/search/wd/{q}.html /vodsearch.html?wd={q} /search.php?searchword={q}
/search.php?q={q} /find?q={q} /search?query={q} /?search={q} /search/{q}.html /search/{q}/""".split()
PROBE_TERMS = {"zh": "微信 电影 教程".split(), "en": "download windows audio".split()}
# --- fixed values: extensions of documents that are resources themselves
DOCUMENTS = "pdf epub mobi azw3 djvu fb2 cbz cbr torrent".split()
# --- fixed values: parts of URLs that a site search doesn't follow
NOT_FOLLOWED = """/category/ /tag/ /author/ /page/ /about /contact /dmca /feed /rss /wp-content /wp-login /wp-json /wp-admin /wp-includes /comments /privacy /terms
/disclaimer /software/win/ /software/mac/ /samples/ /presets/ /?s= /cart /checkout /my-account""".split()
# --- fixed values: hosts that aren't pages worth reading (engines, CDNs, counters), those of them that are, and endings of static files
NOISE_HOSTS = """google. gstatic.com googleapis.com googlesyndication bing.com bing.net brave.com search.brave so.com 360.cn 360.com 360kan.com qhimg.com qhmsg.com
www.baidu.com baidustatic.com bdstatic.com hao123.com duckduckgo.com mojeek.com startpage.com yandex. yimg.com w3.org schema.org cloudflare.com cloudflareinsights
facebook.com twitter.com x.com youtube.com doubleclick.net wikipedia.org creativecommons.org mozilla.org apple.com alicdn.com aliyun.com gtimg.com qq.com sina.com.cn
googletagmanager.com google-analytics.com cnzz.com umeng.com""".split()
CONTENT_HOSTS = ["mp.weixin.qq.com"]
STATIC_ENDINGS = ".css .js .mjs .json .png .jpg .jpeg .gif .svg .ico .woff .woff2 .ttf .mp4 .webp .xml .txt".split()
