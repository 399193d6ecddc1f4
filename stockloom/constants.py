"""Word lists, lookup tables, patterns and limits.

They must equal the published pipeline's for results to agree, so they are
stated as data here and nowhere else.
"""

# Headline lexicon.
POSITIVE_WORDS = [
    "創高", "大漲", "利多", "突破", "買超", "雙增", "新高", "旺",
    "爆發", "成長", "合作", "獲利", "樂觀", "大單", "強勁", "擴產",
]
NEGATIVE_WORDS = [
    "大跌", "衰退", "利空", "大賣", "調降", "虧損", "倒貨", "走弱",
    "崩盤", "保守", "官司", "罰款", "暴跌", "下滑", "斷頭", "延後",
]
LEXICON_SCALE = 0.8

# Labels of a headline-model answer, by the substring they contain.
POSITIVE_LABELS = ["POS", "LABEL_1"]
NEGATIVE_LABELS = ["NEG", "LABEL_2"]

# A news source is accepted if its lower-cased name contains one of these.
SOURCE_KEYWORDS = ["鉅亨", "cnyes", "moneydj", "yahoo股市", "奇摩", "cmoney"]
TITLE_SOURCE_SEPARATOR = " - "

# Investor class -> pattern found in the investor name, in any case (fixed values).
INVESTOR_CLASSES = {
    "foreign_net_buy": "Foreign|外資",
    "trust_net_buy": "Trust|投信",
    "dealer_net_buy": "Dealer|自營商",
}

# Ownership levels: small holders up to, large holders from.
RETAIL_MAX_LEVEL = 3
LARGE_400_MIN_LEVEL = 12
LARGE_1000_MIN_LEVEL = 15

# Header keywords of the weekly ownership file.
OWNERSHIP_HEADERS = {
    "date": ["日期"],
    "stock_id": ["代號"],
    "HoldingSharesLevel": ["分級"],
    "people": ["人數"],
    "percent": ["比例", "占", "佔"],
}

# Statement metric -> (statement, types, origin names, skip percentage types).
STATEMENT_METRICS = {
    "ocf": ("cashflow",
            ["CashFlowsFromOperatingActivities", "NetCashInflowFromOperatingActivities"],
            ["營業活動之淨現金流入（流出）", "營業活動之淨現金流入"], False),
    "ni": ("income",
           ["IncomeAfterTaxes", "IncomeAfterTax"],
           ["本期淨利（淨損）", "本期稅後淨利（淨損）"], False),
    "debt": ("balance", ["Liabilities"], ["負債總額"], True),
    "assets": ("balance", ["TotalAssets"], ["資產總額"], True),
    "op_inc": ("income", ["OperatingIncome"], ["營業利益（損失）"], False),
    "int_exp": ("cashflow",
                ["InterestExpense", "PayTheInterest"],
                ["利息費用", "支付之利息"], False),
    "ar": ("balance",
           ["AccountsReceivable", "NotesAndAccountsReceivable"],
           ["應收帳款", "應收帳款合計", "應收票據及帳款"], False),
    "inv": ("balance", ["Inventories", "Inventory"], ["存貨", "存貨合計"], False),
    "revenue": ("income",
                ["Revenue", "OperatingRevenue"],
                ["營業收入合計", "營業收入", "營業收入淨額"], False),
    "cost": ("income",
             ["OperatingCosts", "CostOfGoodsSold"],
             ["營業成本合計", "營業成本"], False),
}
PERCENT_TYPE_PATTERN = "%_per"

# Default warning thresholds.
DEFAULT_THRESHOLDS = {
    "min_earnings_quality_ratio": 80.0,
    "max_receivable_turnover_days": 120.0,
    "max_inventory_turnover_days": 150.0,
    "max_debt_ratio": 60.0,
    "min_interest_coverage": 3.0,
}
DEBT_HISTORY_QUARTERS = 12
DEBT_STD_WEIGHT = 1.5
DEBT_STD_MISSING = 5.0

# Values of a ratio whose denominator is not positive.
EARNINGS_QUALITY_SENTINEL = 100.0
INTEREST_COVERAGE_SENTINEL = 999.0
DEBT_RATIO_SENTINEL = 0.0
RECEIVABLE_DAYS_SENTINEL = 65.0
INVENTORY_DAYS_SENTINEL = 85.0
QUARTERS_PER_YEAR = 4
DAYS_PER_YEAR = 365

# Phrases of the analyst context, by warning flag.
WARNING_PHRASES = {
    "is_cash_flow_warning": "本期盈餘品質不佳（現金流短缺）",
    "is_debt_warning": "負債比率偏高，超出設定閥值",
    "is_receivable_warning": "應收帳款天數過長",
    "is_inventory_warning": "存貨天數過長，有滯銷可能",
}

# Industry code -> name.
INDUSTRIES = {
    "01": "水泥工業", "02": "食品工業", "03": "塑膠工業", "04": "紡織纖維",
    "05": "電機機械", "06": "電器電纜", "07": "化學工業", "08": "玻璃陶瓷",
    "09": "造紙工業", "10": "鋼鐵工業", "11": "橡膠工業", "12": "汽車工業",
    "13": "電子工業", "14": "建材營造", "15": "航運業", "16": "觀光餐旅",
    "17": "金融保險", "18": "貿易百貨", "19": "綜合", "20": "其他",
    "21": "化學工業", "22": "生技醫療業", "23": "油電燃氣業", "24": "半導體業",
    "25": "電腦及週邊設備業", "26": "光電業", "27": "通信網路業", "28": "電子零組件業",
    "29": "電子通路業", "30": "資訊服務業", "31": "其他電子業", "32": "文化創意業",
    "33": "農業科技業", "34": "電子商務", "35": "綠能環保", "36": "數位雲端",
    "37": "運動休閒", "38": "居家生活",
}
INDUSTRY_DEFAULT = "其他"
MARKET_CLASS = "上市"
BUSINESS_TEXT = "主要業務詳見公司官網"

# Landed company field -> stored column.
COMPANY_FIELDS = {
    "公司代號": "stock_code",
    "公司名稱": "company_name",
    "公司簡稱": "company_name_abbr",
    "英文簡稱": "company_name_en",
    "董事長": "chairman_name",
    "成立日期": "establishment_date",
    "上市日期": "listing_date",
    "產業別": "industry_code",
    "網址": "website",
    "電子郵件信箱": "company_email",
    "總經理": "general_manager",
    "住址": "company_address",
}

# Column of a company backup file -> stored column.
COMPANY_BACKUP_FIELDS = {
    "StockCode": "stock_code",
    "CompanyNameC": "company_name",
    "CompanyNameAbbr": "company_name_abbr",
    "CompanyNameE": "company_name_en",
    "ChairmanName": "chairman_name",
    "EstablishmentDate": "establishment_date",
    "ListingDate": "listing_date",
    "CompanyClass": "company_class",
    "Webside": "website",
    "CompanyEmail": "company_email",
    "GeneralManager": "general_manager",
    "CompanyAddress": "company_address",
    "MarketClass": "market_class",
    "MainBusinessActivities": "main_business",
}

# Row limits and look-backs.
WEEKLY_HISTORY_ROWS = 52
NEWS_SCAN_ROWS = 100
NEWS_SHOWN_ROWS = 30
WARNING_HISTORY_QUARTERS = 12
FLOW_DAYS = 5
NEWS_CONTEXT_ROWS = 5
TREND_CONTEXT_DAYS = 15
NEWS_DEFAULT_DAYS = 90
NEWS_RECENT_DAYS = 7
DAILY_DEFAULT_YEARS = 1
STATEMENT_DEFAULT_YEARS = 2
SENTIMENT_NEUTRAL_BAND = 0.1


# Technical indicators.
MA_SHORT, MA_LONG = 20, 60
STOCHASTIC_ROWS = 9
STOCHASTIC_NEUTRAL = 50.0
RSI_ROWS = 14
EMA_FAST, EMA_SLOW, EMA_SIGNAL = 12, 26, 9
SHORT_SERIES_ROWS = 5
#: Newest rows of a key that are kept at hand.
LATEST_ROWS = 10

# Keys followed by default.
MONITORED_KEYS = [
    "2330", "2317", "2454", "2308", "2382", "2891",
    "2881", "3711", "2882", "2412", "1225",
]
