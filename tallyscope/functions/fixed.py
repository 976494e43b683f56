"""Word lists, patterns and thresholds that results depend on."""

# Law article -> (category, severity).
ARTICLES = {
    8: ("設立許可/負責人", 2),
    12: ("教保服務禁止規定", 4),
    15: ("教職員資料未報備查", 2),
    16: ("教保人員進用/資格", 3),
    17: ("未辦理停聘", 3),
    26: ("設施設備", 3),
    29: ("負責人/董監事資格", 3),
    30: ("安全管理規範未落實", 4),
    31: ("幼童專用車", 3),
    32: ("安全事件", 4),
    33: ("不當對待幼兒", 5),
    38: ("收費未報備查/超收", 2),
    41: ("其他行政義務", 1),
    42: ("未訂書面契約", 1),
    43: ("收費超收", 2),
    48: ("課後照顧違規", 1),
}
DEFAULT_SEVERITY = 2
DEFAULT_CATEGORY = "其他"

# Exact asset register states.
ASSET_ACTIVE = ["外區新領", "外區移入-新領", "外站新領", "外站移入-新領",
                "本區新領", "本區繳銷重領", "本區註銷重領"]
ASSET_INACTIVE = ["一般報廢", "停駛轉報廢", "停駛轉繳銷", "環保回收轉報廢", "繳銷",
                  "繳銷轉報廢", "註銷轉報廢", "逕行註銷執行", "逾檢註銷"]
ASSET_SUSPENDED = ["停用報停", "執行條例處分吊扣"]

# Sanction prefixes -> form.
SANCTION_PREFIXES = [
    ("停止招生", "stop_enrollment"),
    ("減少招收人數", "reduced_enrollment"),
    ("廢止設立許可", "permit_revoked"),
    ("停辦", "operation_suspended"),
]
ESCALATING_TYPES = ["fine", "operation_suspended", "permit_revoked",
                    "reduced_enrollment", "stop_enrollment"]

# Patterns (Java regular expressions).
ANY_SPACE = r"[\s　 ]+"
NUMBER = r"([\d,]+(?:\.\d+)?)"
MONEY = r"([\d,]+)\s*元"
ACTOR = r"^([^：:]+)[：:](.*)$"
LAW_CITATION = r"第(\d+)條(?:第(\d+)項)?"
OPERATOR_CLAUSE = r"[（(](?:委託)?(.+?)(?:申請)?辦理[）)]"
BRANCH = r"^(.+?幼兒園).+分班$"
MINGUO_DATE = r"(\d{2,3})年(\d{1,2})月(?:(\d{1,2})日)?"
DOTTED_DATE = r"(\d{2,3})[年.](\d{1,2})[月.](\d{1,2})日?"
HASHTAG = r"#([0-9A-Za-z_一-鿿]{2,40})"
CLAUSE_MARK = r"(?=[(（][一二三四五六七八九十]+[)）])"
PUBLISHER_TAIL = r"\s*[-|｜]\s*[^-|｜]{1,24}$"
DIGIT_RUN = r"\d[\d,]*"

# Words and spellings.
LEGAL_FORMS = ["財團法人", "社團法人", "學校財團法人"]
DOC_DOUBLED = "教幼字字第"
DOC_SINGLE = "教幼字第"
FACILITY_WORDS = ["幼兒園", "幼稚園", "教保服務中心"]
TITLE_NOISE = (r"新北市|私立|市立|公立|非營利|附設|幼兒園|教保服務中心|"
               r"股份有限公司|有限公司|財團法人|社團法人|學校財團法人|基金會|[（(].*?[)）]")
DISTRICTS = ["板橋", "三重", "中和", "永和", "新莊", "新店", "樹林", "鶯歌", "三峽", "淡水", "汐止", "土城", "蘆洲", "五股", "泰山",
             "林口", "深坑", "石碇", "坪林", "三芝", "石門", "八里", "平溪", "雙溪", "貢寮", "金山", "萬里", "烏來", "瑞芳"]
OTHER_CITIES = ["臺北市", "台北市", "北市", "桃園", "臺中", "台中", "臺南", "台南", "高雄", "基隆", "新竹", "苗栗", "彰化", "南投", "雲林",
                "嘉義", "屏東", "宜蘭", "花蓮", "臺東", "台東"]
OWN_CITY = "新北市"
INCIDENT_WORDS = ["不當對待", "虐童", "體罰", "裁罰", "開罰", "違反", "停辦", "廢止", "超收",
                  "退費", "申訴", "調查", "查處", "處分", "勒令", "食安", "受傷"]
ROUTINE_WORDS = ["招生", "開學", "活動", "評鑑通過", "揭牌", "參訪", "捐贈", "表揚"]
VERDICT_WORDS = ["違法", "不法", "違規", "犯罪", "舞弊", "掏空", "圖利"]
VERDICT_NEGATIONS = ["非違法認定", "不是違法認定", "不構成違法認定", "非屬違法認定"]
DISCLAIMER = "非違法認定"

# Feed wrappers and field aliases, in lookup order.
FEED_WRAPPERS = ["data", "items", "results", "posts", "records", "list"]
FEED_ALIASES = {
    "text": ["text", "content", "title", "post_text", "message", "caption", "snippet", "body"],
    "url": ["url", "link", "permalink", "post_url", "postUrl", "href"],
    "date": ["date", "published", "publishedAt", "timestamp", "created_at", "createdAt",
             "post_time", "publish_time"],
    "author": ["author", "username", "user", "screen_name", "channel", "source", "authorName"],
}

# Thresholds.
MINGUO_OFFSET = 1911
NEVER_DAYS = 9999
MAD_TO_SD = 1.4826
IQR_TO_SD = 1.349
Z_REPORT = 3.5
Z_CAP = 8.0
MIN_PEERS = 8
MIN_PEERS_BUDGET = 6
PEER_Z = 2.0
MONEY_TOL = 1.0
GAP_TOL = 1000.0
LAG_TOL = 0.05
RESERVE_CAP = 0.20
RESERVE_MARGIN = 0.22
RELATED_PARTY_MATERIALITY = 0.10
FEE_IDENTITY_TOL = 0.05
CAPACITY_GAP_TOL = 20
STAFF_RATIO_LEGAL = 15.0
STAFF_RATIO_WATCH = 13.0
IMPLIED_BUDGET_CAP = 1.05
STAFF_GAP_MIN = 3
STAFF_GAP_HIGH = 10
CAPEX_OVER = 1.5
CAPEX_UNDER = 0.5
DEPENDENCY_HIGH = 0.95
MIN_EXPECTED = 1.0
RECENCY_STEPS = [(7, 1.0), (30, 0.6), (90, 0.3), (365, 0.1)]
HEAT_TIERS = [(2.0, 3), (0.6, 2)]
ECHO_WIDTH = 12
BM25_K1 = 1.2
BM25_B = 0.75
