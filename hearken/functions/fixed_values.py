"""Fixed values.

Word lists, patterns, code tables, limits and names that have to equal the published ones for the
results to come out the same. Nothing in here is logic.
"""

# --- text ------------------------------------------------------------------------------------

CLEAN_KEEP = "가-힣a-zA-Z0-9"
MARKUP = "<[^>]+>"
MIN_REVIEW_LENGTH = 5

STOPWORDS = (
    "하다", "되다", "있다", "없다", "같다", "이다", "보다", "주다", "받다",
    "너무", "정말", "진짜", "그냥", "계속", "다시", "때문", "경우", "부분",
    "사용", "기능", "어플", "앱",
)

WORD_CHART_STOPWORDS = (
    "앱", "어플", "사용", "때문", "진짜", "정말", "그냥", "계속", "다시", "너무",
    "이거", "저거", "그거", "지금", "오늘", "요즘", "please", "lg", "엘지",
    "씽큐", "띵큐", "thinq", "하다", "되다", "있다", "없다", "같다", "보다",
)

# --- search snippets -------------------------------------------------------------------------

SPONSORED = r"원고료|협찬|제공받아|체험단"
DEVICE_NOISE = r"G[5-9]\s*ThinQ|V[345]0\s*ThinQ|스냅드래곤|스마트폰.{0,10}(사양|스펙|출시)"
APP_MENTION = r"씽큐|ThinQ|thinq"
OFF_TOPIC = (
    r"인터넷\s*(가입|설치|결합|이전)|사은품|현금\s*지원"
    r"|주식|종목|PBR|배당|씽큐베이션|서평|기자|보도자료"
)
AXIS_SIGNAL = {
    "A_집이바뀜": r"이사|이전\s*설치|공유기|인터넷\s*이전|신혼집|입주|새\s*집",
    "B_사람기기바뀜": r"폰\s*바꾸|기기\s*변경|기변|가족|공유|초대|계정\s*이전|부모님",
    "C_경쟁대안": r"스마트싱스|SmartThings|삼성|홈어시스턴트|Home\s*Assistant|구글홈|홈킷|워치",
    "D_계정거부": r"회원가입|계정|개인정보|탈퇴|약관",
}
AXIS_YIELD_THRESHOLD = 18.8
EXPERIENCE = r"저도|제가|우리\s*집|저희\s*집|했더니|하니까|당했|겪|짜증|화가|스트레스|포기|결국"
GUIDE_TONE = r"해결법|꿀팁|총정리|방법\s*안내|가이드|STEP|정리해\s*드"
RESET_SIGNAL = (
    r"재등록|다시\s*등록|첨부터\s*다시|처음부터\s*다시"
    r"|등록.{0,10}(날아|사라|없어|삭제|초기화|풀리)"
    r"|(제품|기기|설정|목록).{0,12}(날아|사라|없어졌|다\s*삭제|초기화)"
    r"|초기화.{0,10}(되|됨|시켜|후)"
)

# --- sentiment and topics ----------------------------------------------------------------------

LABEL_MAP = {"LABEL_0": "neg", "LABEL_1": "pos"}
EMBEDDING_MODEL = "jhgan/ko-sroberta-multitask"
NEGATIVE_RATING = 3
NOISE_TOPIC = -1
SMALL_CORPUS = 20
TFIDF_TERMS = 2000
TFIDF_TOP = 15
COUNT_TERMS = 1000
LDA_TOPICS = 5
LDA_SEED = 42
TOPIC_LABEL_WORDS = 4
MIN_TOPIC_SIZE = 5
TOPICS_ON_VECTORS = 16
QUOTE_LENGTH = 100
STRENGTH_ROWS = 10

# --- survey ------------------------------------------------------------------------------------

QUESTION_PREFIX = {
    "q1": "1.", "q2": "2.", "q3": "3.", "q4": "4.", "q5": "5.", "q6": "6.",
    "q7": "7.", "q8": "8.", "q9": "9.", "q10": "10.",
    "q11_1": "11-1.", "q11_2": "11-2.", "q11_3": "11-3.",
    "q12": "12.", "q13": "13.", "q13_1": "13-1.", "q13_2": "13-2.",
    "q15": "15.",
}
CODEBOOK = {
    "q1": {"0대 (없음)": 0.0, "1대": 1.0, "2~3대": 2.0, "4대 이상": 3.0},
    "q2": {"사용해본 적 없음": 0.0, "설치만 해둠": 1.0, "월 1회 이하": 2.0, "주 1~2회": 3.0,
           "거의 매일": 4.0},
    "q3": {"20대 이하": 1.0, "30대": 2.0, "40대": 3.0, "50대": 4.0, "60대 이상": 5.0},
    "q5": {"자가": 0.0, "전세": 1.0, "월세": 1.0},
    "q6": {"있다": 1.0, "없다": 0.0, "아직 모르겠다": 0.5},
    "q13": {"무료가 아니면 쓰지 않겠다": 0.0, "무료로 써보고 괜찮으면 유료도 고려하겠다": 1.0,
            "유료라도 쓸 의향이 있다": 2.0},
}
SCREENED_OUT = "0대 (없음)"
CHILD_KEYWORD = "자녀 있음"
WEDDING_KEYWORD = "혼수"
NO_CHOICE = "없음"
TENURE_ALERT_PCT = 20.0
# Feature -> report header, in report order.
FEATURE_HEADERS = {
    "devices_owned": "LG가전수",
    "app_frequency": "앱사용빈도",
    "age_band": "연령대",
    "has_child": "자녀유무",
    "is_renter": "점유형태_전월세",
    "move_plan": "이사계획",
    "wedding_purchase": "구매계기_혼수",
    "p1_experience": "P1경험",
    "p2_experience": "P2경험",
    "p3_burden": "P3부담",
    "owns_watch": "워치보유",
    "night_use": "야간사용",
    "onbody_intent": "온바디수용도",
    "pay_intent": "지불의사",
}
VERBATIM_HEADERS = {
    "tenure_text": "점유형태_원문",
    "situation_text": "상황선택_원문",
    "worry_text": "걱정_원문",
    "pricing_text": "과금형태_원문",
    "channel": "유입채널",
}
HOLDOUT_SCALES = {"onbody_intent": (1, 2, 3, 4, 5), "pay_intent": (0, 1, 2)}
QUOTES_PER_SEGMENT = 5
MIN_RESPONDENTS = 10
SEGMENT_SEED = 42
SEGMENT_RESTARTS = 10
SEGMENT_K_MAX = 7

# --- lineage gate --------------------------------------------------------------------------------

REQUIRED_BUNDLE = (
    "reviews_raw.csv", "reviews_clean.csv", "painpoints.csv", "strengths.csv",
    "metadata.json", "preprocess_meta.json", "painpoints_meta.json",
)
REAL_SOURCE = "google_play"
SURVEY_SOURCE = "survey"
DEMO_SOURCE = "synthetic_demo"
RATING_METHOD = "rating_fallback"
MODEL_METHOD = "deep_learning"
STRENGTH_RATING_RANGE = {"rating_fallback": (4, 5), "deep_learning": (1, 5)}
MENTION_TOLERANCE = 0.1
MIN_DOCUMENTS = 3
MIN_NEGATIVES = 5

# --- table exports: column -> published header -------------------------------------------------------

PAINPOINT_HEADERS = {
    "topic_label": "PainPoint(토픽)",
    "freq": "빈도",
    "avg_rating": "평균평점",
    "mention_all_pct": "언급률_전체부정기준(%)",
    "mention_assigned_pct": "언급률_배정기준(%)",
    "rep_review": "대표리뷰",
}
STRENGTH_HEADERS = {"review": "대표리뷰", "rating": "평점", "likes": "좋아요"}

# --- transcription score ------------------------------------------------------------------------------

SCORE_WEIGHTS = {
    "B": {"quotes": 40.0, "figures": 30.0, "gate": 15.0, "sources": 10.0, "columns": 5.0},
    "E": {"persona": 30.0, "demographics": 25.0, "unverified": 20.0, "label": 15.0, "voc": 10.0},
}
SCORE_MIX = {"E": 0.4, "B": 0.35}

# --- home profiles ---------------------------------------------------------------------------------

SCHEMA_VERSION = "1.0.0"
PROFILE_KEYS = ("schema_version", "devices", "settings", "routines", "reserved_wellness")
DEVICE_KEYS = ("device_ref", "device_type", "capabilities")
ROUTINE_KEYS = ("trigger", "actions")
TRIGGER_KEYS = ("type", "params")
ACTION_KEYS = ("device_ref", "setting_key", "value")
TOKEN_SHAPE = r"^[a-z0-9][a-z0-9_-]{0,31}$"
KEY_SHAPE = r"^[a-z0-9][a-z0-9_]{0,31}$"
IDENTIFIER_FRAGMENTS = (
    "name", "account", "email", "phone", "user_id", "userid",
    "birth", "address", "contact", "ssn", "gender", "owner",
    "resident", "alias", "nickname",
    "이름", "계정", "이메일", "메일주소", "전화", "연락처", "주소",
    "생년", "생일", "주민", "성별", "소유자",
)
LOCATION_KEYS = (
    "ssid", "mac", "serial", "imei", "lat", "lon",
    "latitude", "longitude", "geo", "gps",
)
WELLNESS_FRAGMENTS = (
    "sleep", "wellness", "health", "heart", "hrv", "blood", "spo2",
    "stress", "body_fat", "bp_", "calorie", "weight", "pulse", "glucose",
)
EMAIL_SHAPE = r"[\w.+-]+@[\w-]+\.[\w.]+"
PHONE_SHAPE = r"01[016789][-\s]?\d{3,4}[-\s]?\d{4}"
NATIONAL_ID_SHAPE = r"\d{6}[-\s]?[1-4]\d{6}"
IDENTIFIER_PHRASES = ("이름", "전화번호", "주민등록", "성명", "연락처")
MAX_VALUE_LENGTH = 256
MAX_SETTING_LENGTH = 64
MAX_INT_DIGITS = 20
MAX_DEVICES = 30
MAX_ROUTINES = 20
MAX_CAPABILITIES = 12
MAX_SETTINGS = 12
MAX_ACTIONS = 10
MAX_TRIGGER_PARAMS = 5
RECORD_BUDGET = 4096
STORE_BUDGET = 131072
FRAME_MTU = 20
MAX_FRAMES = 255
COMMAND_VERSION = 1
COMMAND_BUDGET = 1024

CAPABILITIES = (
    "power", "target_temp", "fan_speed", "mode", "timer_min",
    "child_lock", "eco_mode", "humidity", "filter_state", "schedule",
)
SWITCHES = ("power", "child_lock", "eco_mode")
CHOICES = {
    "fan_speed": ("low", "mid", "high"),
    "mode": ("cool", "heat", "dry", "auto"),
    "filter_state": ("on", "off", "standby"),
    "schedule": ("on", "off", "standby"),
}
RANGES = {"target_temp": (0, 40), "humidity": (0, 100), "timer_min": (0, 1440)}

HELD_NO_TYPE = "no_matching_type"
HELD_CAPABILITY = "capability_unsupported"
HELD_ROUTINE = "routine_action_unmappable"
HELD_ABORTED = "mapping_aborted"
