"""Fixed values that results depend on, plus the defaults built from them."""

# --- fixed values: categories, duties and code labels ---
CATEGORIES = ("it_language", "framework", "library", "tool")
LANGUAGE_DUTY = "언어별 개발자"
DUTIES = (
    "PM", "데이터 직무", "백엔드", "인프라 엔지니어", "앱 개발자", "게임", "AI", "임베디드",
    "프론트 엔드", "QA", "데이터 분석", "VR", "시스템", "블록체인", "ERP", "언어별 개발자",
)
LANGUAGE_LABELS = {1: "영어", 2: "일본어", 3: "중국어"}
NO_LANGUAGE_LABEL = "무관"
DEGREE_LABELS = {0: "무관/없음", 1: "학사", 2: "석사&박사"}
LANGUAGE_WORDS = {"어학": 1, "외국어": 1, "영어": 1, "일본어": 2, "일어": 2, "중국어": 3, "중어": 3}

# --- fixed values: degree words ---
BACHELOR_WORDS = ("학사", "대졸")
SCHOOL_WORDS = ("대학교", "대학")
GRADUATE_WORDS = ("졸업자", "졸업")
HIGHER_WORDS = ("석사", "박사")

# --- fixed values: career texts ---
ANY_CAREER = "경력 무관"
NEWCOMER = "신입"
NEWCOMER_LABEL = "신입사원"
YEAR_SUFFIX = "년차"

# --- fixed values: placeholders ---
DELETE_MARKER = "삭제"
NO_TITLE = "제목 없음"
NO_COMPANY = "회사명 없음"
NO_URL = "URL 없음"
NO_DEADLINE = "마감 기한 없음"
NOT_AVAILABLE = "N/A"
OUTSIDE = "O"

# --- fixed values: addresses the two feeds put before their own paths and ids ---
FEED_A_URL = "https://career.programmers.co.kr"
FEED_B_URL = "https://www.wanted.co.kr/wd/"

# --- fixed values: region patterns, first match wins ---
OTHER_REGION = "기타"
REGION_RULES = (
    ("서울", "서울|서울특별시"),
    ("경기", "경기|경기도"),
    ("인천", "인천|인천광역시"),
    ("강원", "강원|강원도"),
    ("부산", "부산|부산광역시"),
    ("대구", "대구|대구광역시"),
    ("대전", "대전|대전광역시"),
    ("광주", "광주|광주광역시"),
    ("울산", "울산|울산광역시"),
    ("세종", "세종|세종특별자치시"),
    ("제주", "제주|제주특별자치도"),
    ("전북", "전북|전라북도"),
    ("전남", "전남|전라남도"),
    ("충북", "충북|충청북도"),
    ("충남", "충남|충청남도"),
    ("경북", "경북|경상북도"),
    ("경남", "경남|경상남도"),
    ("재택", "재택|재택근무|재택 근무"),
)

# --- fixed values: job category ids of the first feed ---
JOB_CATEGORY_NAMES = {
    1: "서버/백엔드", 2: "안드로이드", 3: "iOS", 4: "프론트엔드", 5: "머신러닝",
    6: "블록체인", 7: "모바일 게임", 9: "시스템/네트워크", 10: "QA", 11: "인공지능(AI)",
    12: "데이터 엔지니어링", 13: "사물인터넷(IoT)", 16: "게임 클라이언트", 17: "응용 프로그램",
    18: "시스템 소프트웨어", 20: "게임 서버", 22: "인터넷 보안", 25: "웹 풀스택",
    26: "임베디드 소프트웨어", 27: "로보틱스 미들웨어", 59: "데브옵스", 92: "DBA",
    125: "개발PM", 126: "웹 퍼블리싱", 127: "크로스 플랫폼", 128: "VR/AR/3D",
    129: "ERP", 130: "그래픽스", 158: "데이터 분석",
}

# --- fixed values: headings that open a section of a posting page, first group wins ---
SECTION_KEYWORDS = (
    ("description", (
        "직무 설명", "포지션 소개", "주요업무", "주요 업무", "주요 소개", "조직소개",
        "직무 소개", "직무소개",
    )),
    ("requirement", ("자격 요건", "자격요건", "자격 조건", "자격조건", "지원자격", "지원 자격")),
    ("preferredExperience", ("우대 사항", "우대사항", "우대 조건", "우대조건")),
)
SECTION_TAGS = ("h2", "h3", "strong", "ul", "li")

# --- fixed values: category weights per duty (it_language, framework, library, tool) ---
DUTY_WEIGHTS = {
    "PM": (0.2, 0.25, 0.45, 0.1),
    "백엔드": (0.3, 0.45, 0.3, 0.15),
    "데이터 직무": (0.1, 0.4, 0.4, 0.1),
    "인프라 엔지니어": (0.2, 0.35, 0.3, 0.15),
    "앱 개발자": (0.3, 0.45, 0.1, 0.15),
    "게임": (0.3, 0.2, 0.2, 0.3),
    "AI": (0.4, 0.1, 0.4, 0.1),
    "임베디드": (0.4, 0.1, 0.4, 0.1),
    "프론트 엔드": (0.3, 0.4, 0.2, 0.1),
    "QA": (0.3, 0.3, 0.2, 0.2),
    "데이터 분석": (0.4, 0.25, 0.25, 0.1),
    "VR": (0.5, 0.1, 0.1, 0.3),
    "시스템": (0.25, 0.3, 0.15, 0.3),
    "블록체인": (0.2, 0.3, 0.3, 0.2),
    "ERP": (0.4, 0.3, 0.1, 0.2),
    "언어별 개발자": (0.7, 0.1, 0.1, 0.1),
}

# --- fixed values: token labels ---
TAG_IDS = {
    "O": 0,
    "B-LANGUAGES": 1, "B-FRAMEWORKS": 2, "B-LIBRARIES": 3, "B-TOOLS": 4,
    "I-LANGUAGES": 5, "I-FRAMEWORKS": 6, "I-LIBRARIES": 7, "I-TOOLS": 8,
}
LABEL_CATEGORIES = {"B-LANG": "language", "B-FRAME": "framework", "B-LIB": "library", "B-TOOL": "tool"}
CATEGORY_ORDER = ("language", "framework", "library", "tool")
IGNORED_LABEL = -100

# --- fixed values: suffixes that get a space in front, first match wins ---
SPACED_SUFFIXES = ("db", "sql", "js")

# --- fixed values: word shapes ---
LATIN_TOKEN = r"^[a-zA-Z0-9#+\-\s]+$"
WORD_RUN = "[a-z0-9#+]+"
TERM_PATTERN = r"(?U)\b\w\w+\b"

# --- fixed values: patterns of career spans, single years, sentence ends, numbering and tuple text ---
CAREER_SPAN = r"(\d+)\s*~\s*(\d+)"
CAREER_YEARS = r"(\d+)"
SENTENCE_END = r"(?<!\d)\.\s+|- "
INLINE_NUMBER = r"\d+\.\s+"
TUPLE_TEXT = r"\('(.+)', '(.+)'\)"
