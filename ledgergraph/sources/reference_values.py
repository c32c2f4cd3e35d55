"""Fixed values that must equal the modelled system's data for results to match.

Everything below is configuration, stated plainly and in its natural order:
the account master, the account graph (child -> parent with a role), the
time/apply lexicon, the label maps, the utterance templates and a few word
lists.  Larger tables (the triple set, the closure, the coefficient table)
are *derived* from these by rules in :mod:`ledgergraph.sources.ontology`.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — account master.
# (acc, local name, english name, group "Statement-Kind-Level")
# ---------------------------------------------------------------------------
ACCOUNT_MASTER = [
    ("CurrentAssets", "유동자산", "Current Assets", "BS-Value-3"),
    ("CashAndCashEquivalents", "현금및현금성자산", "Cash and Cash Equivalents", "BS-Value-4"),
    ("TradeAndOtherCurrentReceivables", "매출채권", "Trade and Other Current Receivables", "BS-Value-4"),
    ("PrepaidExpenses", "선급비용", "Prepaid Expenses", "BS-Value-4"),
    ("Inventories", "재고자산", "Inventories", "BS-Value-4"),
    ("NoncurrentAssets", "비유동자산", "Noncurrent Assets", "BS-Value-3"),
    ("PropertyPlantAndEquipment", "유형자산", "Property Plant and Equipment", "BS-Value-4"),
    ("IntangibleAssets", "무형자산", "Intangible Assets", "BS-Value-4"),
    ("AssetsAbstract", "자산총계", "Assets", "BS-Value-1"),
    ("CurrentLiabilities", "유동부채", "Current Liabilities", "BS-Value-3"),
    ("TradeAndOtherCurrentPayables", "매입채무 및 기타유동채무", "Trade and Other Current Payables", "BS-Value-4"),
    ("ShortTermBorrowings", "단기차입금", "Short Term Borrowings", "BS-Value-4"),
    ("AdvancesCustomers", "선수금", "Advances Customers", "BS-Value-4"),
    ("NoncurrentLiabilities", "비유동부채", "Noncurrent Liabilities", "BS-Value-3"),
    ("BondsIssued", "사채", "Bonds Issued", "BS-Value-4"),
    ("LongTermBorrowings", "장기차입금", "Long Term Borrowings", "BS-Value-4"),
    ("LiabilitiesAbstract", "부채총계", "Liabilities", "BS-Value-2"),
    ("EquitiesAbstract", "자본총계", "Equities", "BS-Value-2"),
    ("LiabilitiesAndEquities", "부채와자본총계", "Liabilities and Equities", "BS-Value-1"),
    ("TradeReceivableTurnoverPeriod", "매출채권 회전기간", "Trade Receivable Turnover Period", "BS-Ratio-98"),
    ("PrepaidExpensesTurnoverPeriod", "선급비용 회전기간", "Prepaid Expenses Turnover Period", "BS-Ratio-98"),
    ("InventoriesTurnoverPeriod", "재고자산 회전기간", "Inventories Turnover Period", "BS-Ratio-98"),
    ("TradePayablesTurnoverPeriod", "매입채무 회전기간", "Trade Payables Turnover Period", "BS-Ratio-98"),
    ("AdvancesCustomersTurnoverPeriod", "선수금 회전기간", "Advances Customers Turnover Period", "BS-Ratio-98"),
    ("Revenue", "수익(매출액)", "Revenue", "IS-Value-5"),
    ("CostOfSales", "매출원가", "Cost of Sales", "IS-Value-5"),
    ("GrossProfit", "매출총이익", "Gross Profit", "IS-Value-4"),
    ("SellingGeneralAdministrativeExpenses", "판매비와관리비", "Selling General Administrative Expenses", "IS-Value-4"),
    ("OperatingIncome", "영업이익", "Operating Income", "IS-Value-3"),
    ("FinanceIncome", "금융수익", "Finance Income", "IS-Value-3"),
    ("FinancialExpenses", "금융비용", "Financial Expenses", "IS-Value-3"),
    ("ProfitBeforeTax", "법인세비용차감전순이익(손실)", "Profit Before Tax", "IS-Value-2"),
    ("IncomeTaxExpense", "법인세비용", "IncomeTax Expense", "IS-Value-2"),
    ("Profit", "당기순이익(손실)", "Profit", "IS-Value-1"),
    ("CostOfSalesRatio", "매출원가율", "Cost of Sales Ratio", "IS-Ratio-98"),
    ("SellingGeneralAdministrativeRatio", "판관비율", "Selling General Administrative Ratio", "IS-Ratio-98"),
    ("SalesAndSellingGeneralAdministrativeRatio", "매출 및 판관 비율", "Sales and Selling General Administrative Ratio", "IS-Ratio-98"),
    ("IncomeTaxRatio", "법인세율", "Income Tax Ratio", "IS-Ratio-98"),
    ("ProfitRatio", "순이익율", "Profit Ratio", "IS-Ratio-98"),
    ("IncomeStatement", "손익계산서", "Income Statement", "IS-Value-0"),
    ("BalanceSheet", "재무상태표", "Balance Sheet", "BS-Value-0"),
    ("CalendarOneYear", "365 일", "365 days", "TIME-Value-99"),
    ("Ratios", "재무비율", "Finance Ratio", "FS-Ratio-0"),
]

# FIXED VALUES — accounts whose Account_Property is Negative (all other
# typed accounts are Positive, except the three below that carry no sign).
NEGATIVE_ACCOUNTS = [
    "CostOfSales",
    "SellingGeneralAdministrativeExpenses",
    "FinancialExpenses",
    "IncomeTaxExpense",
]
UNSIGNED_ACCOUNTS = ["BalanceSheet", "IncomeStatement", "Ratios"]

# FIXED VALUES — structural accounts left out of corpora and slot filling.
STRUCTURAL_ACCOUNTS = ["BalanceSheet", "IncomeStatement", "Ratios", "CalendarOneYear"]

# ---------------------------------------------------------------------------
# FIXED VALUES — account graph edges (child, parent, role).
# ---------------------------------------------------------------------------
ACCOUNT_EDGES = [
    ("CurrentAssets", "AssetsAbstract", "partOf"),
    ("CashAndCashEquivalents", "CurrentAssets", "partOf"),
    ("TradeAndOtherCurrentReceivables", "CurrentAssets", "partOf"),
    ("TradeAndOtherCurrentReceivables", "TradeReceivableTurnoverPeriod", "numerator"),
    ("PrepaidExpenses", "CurrentAssets", "partOf"),
    ("PrepaidExpenses", "PrepaidExpensesTurnoverPeriod", "numerator"),
    ("Inventories", "CurrentAssets", "partOf"),
    ("Inventories", "InventoriesTurnoverPeriod", "numerator"),
    ("NoncurrentAssets", "AssetsAbstract", "partOf"),
    ("PropertyPlantAndEquipment", "NoncurrentAssets", "partOf"),
    ("IntangibleAssets", "NoncurrentAssets", "partOf"),
    ("AssetsAbstract", "BalanceSheet", "partOf"),
    ("CurrentLiabilities", "LiabilitiesAbstract", "partOf"),
    ("TradeAndOtherCurrentPayables", "CurrentLiabilities", "partOf"),
    ("TradeAndOtherCurrentPayables", "TradePayablesTurnoverPeriod", "numerator"),
    ("ShortTermBorrowings", "CurrentLiabilities", "partOf"),
    ("AdvancesCustomers", "CurrentLiabilities", "partOf"),
    ("AdvancesCustomers", "AdvancesCustomersTurnoverPeriod", "numerator"),
    ("NoncurrentLiabilities", "LiabilitiesAbstract", "partOf"),
    ("BondsIssued", "NoncurrentLiabilities", "partOf"),
    ("LongTermBorrowings", "NoncurrentLiabilities", "partOf"),
    ("LiabilitiesAbstract", "LiabilitiesAndEquities", "partOf"),
    ("EquitiesAbstract", "LiabilitiesAndEquities", "partOf"),
    ("LiabilitiesAndEquities", "BalanceSheet", "partOf"),
    ("Revenue", "GrossProfit", "partOf"),
    ("Revenue", "TradeReceivableTurnoverPeriod", "denominator"),
    ("Revenue", "PrepaidExpensesTurnoverPeriod", "denominator"),
    ("Revenue", "InventoriesTurnoverPeriod", "denominator"),
    ("Revenue", "TradePayablesTurnoverPeriod", "denominator"),
    ("Revenue", "AdvancesCustomersTurnoverPeriod", "denominator"),
    ("Revenue", "CostOfSalesRatio", "denominator"),
    ("Revenue", "SellingGeneralAdministrativeRatio", "denominator"),
    ("Revenue", "ProfitRatio", "denominator"),
    ("CostOfSales", "GrossProfit", "partOf"),
    ("CostOfSales", "CostOfSalesRatio", "numerator"),
    ("GrossProfit", "OperatingIncome", "partOf"),
    ("SellingGeneralAdministrativeExpenses", "OperatingIncome", "partOf"),
    ("SellingGeneralAdministrativeExpenses", "SellingGeneralAdministrativeRatio", "numerator"),
    ("OperatingIncome", "ProfitBeforeTax", "partOf"),
    ("FinanceIncome", "ProfitBeforeTax", "partOf"),
    ("FinancialExpenses", "ProfitBeforeTax", "partOf"),
    ("ProfitBeforeTax", "Profit", "partOf"),
    ("ProfitBeforeTax", "IncomeTaxRatio", "denominator"),
    ("IncomeTaxExpense", "Profit", "partOf"),
    ("IncomeTaxExpense", "IncomeTaxRatio", "numerator"),
    ("Profit", "IncomeStatement", "partOf"),
    ("Profit", "ProfitRatio", "numerator"),
    ("TradeReceivableTurnoverPeriod", "Ratios", "partOf"),
    ("PrepaidExpensesTurnoverPeriod", "Ratios", "partOf"),
    ("InventoriesTurnoverPeriod", "Ratios", "partOf"),
    ("TradePayablesTurnoverPeriod", "Ratios", "partOf"),
    ("AdvancesCustomersTurnoverPeriod", "Ratios", "partOf"),
    ("CostOfSalesRatio", "Ratios", "partOf"),
    ("CostOfSalesRatio", "SalesAndSellingGeneralAdministrativeRatio", "partOf"),
    ("SellingGeneralAdministrativeRatio", "Ratios", "partOf"),
    ("SellingGeneralAdministrativeRatio", "SalesAndSellingGeneralAdministrativeRatio", "partOf"),
    ("SalesAndSellingGeneralAdministrativeRatio", "Ratios", "partOf"),
    ("IncomeTaxRatio", "Ratios", "partOf"),
    ("ProfitRatio", "Ratios", "partOf"),
    ("CalendarOneYear", "TradeReceivableTurnoverPeriod", "numerator"),
    ("CalendarOneYear", "PrepaidExpensesTurnoverPeriod", "numerator"),
    ("CalendarOneYear", "InventoriesTurnoverPeriod", "numerator"),
    ("CalendarOneYear", "TradePayablesTurnoverPeriod", "numerator"),
    ("CalendarOneYear", "AdvancesCustomersTurnoverPeriod", "numerator"),
]

# FIXED VALUES — non-account vocabulary of the triple set.
VOCAB_TRIPLES = [
    ("acc:CalendarOneYear", "rdf:type", "time:DateTimeDescription"),
    ("acc:CalendarOneYear", "time:hasDuration", "time:day"),
    ("acc:CalendarOneYear", "time:Duration", "365"),
    ("acc:denominator", "rdf:type", "acc:Relation"),
    ("acc:denominator", "acc:partOf", "acc:division"),
    ("acc:numerator", "rdf:type", "acc:Relation"),
    ("acc:numerator", "acc:partOf", "acc:division"),
    ("acc:YoYRatio", "rdf:type", "acc:MathFunction"),
    ("acc:multiplication", "rdf:type", "acc:MathFunction"),
    ("acc:addition", "rdf:type", "acc:MathFunction"),
    ("acc:division", "rdf:type", "acc:MathFunction"),
    ("acc:partOf", "rdf:type", "acc:Relation"),
    ("acc:partOf", "rdfs:label", "partOf"),
    ("acc:IncomeStatement", "rdf:type", "rdfs:Class"),
    ("acc:BalanceSheet", "rdf:type", "rdfs:Class"),
    ("acc:MathFunction", "rdf:type", "rdfs:Class"),
    ("acc:FinancialStatement", "rdf:type", "rdfs:Class"),
    ("acc:Relation", "rdf:type", "rdfs:Class"),
    ("acc:hasPart", "rdf:type", "acc:InverseRelation"),
    ("acc:hasPart", "owl:inverseOf", "acc:partOf"),
    ("acc:isDenominatorOf", "rdf:type", "acc:InverseRelation"),
    ("acc:isDenominatorOf", "owl:inverseOf", "acc:denominator"),
    ("acc:isNumeratorOf", "rdf:type", "acc:InverseRelation"),
    ("acc:isNumeratorOf", "owl:inverseOf", "acc:numerator"),
]

# FIXED VALUES — predicate and its inverse.
INVERSE_PREDICATES = [
    ("partOf", "hasPart"),
    ("numerator", "isNumeratorOf"),
    ("denominator", "isDenominatorOf"),
]

# FIXED VALUES — namespace prefixes used by the triple set.
NAMESPACES = [
    ("acc", "http://www.example.org/account#"),
    ("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"),
    ("rdfs", "http://www.w3.org/2000/01/rdf-schema#"),
    ("owl", "http://www.w3.org/2002/07/owl#"),
    ("time", "http://www.w3.org/2006/time#"),
]

# FIXED VALUES — named knowledge subsets (node lists of the BS and IS views).
KNOWLEDGE_SUBSETS = {
    "BS": [
        "CurrentAssets", "CashAndCashEquivalents", "TradeAndOtherCurrentReceivables", "PrepaidExpenses",
        "Inventories", "NoncurrentAssets", "PropertyPlantAndEquipment", "IntangibleAssets", "AssetsAbstract",
        "CurrentLiabilities", "TradeAndOtherCurrentPayables", "ShortTermBorrowings", "AdvancesCustomers",
        "NoncurrentLiabilities", "BondsIssued", "LongTermBorrowings", "LiabilitiesAbstract", "EquitiesAbstract",
        "LiabilitiesAndEquities", "BalanceSheet", "IncomeStatement", "TradeReceivableTurnoverPeriod",
        "InventoriesTurnoverPeriod", "TradePayablesTurnoverPeriod", "AdvancesCustomersTurnoverPeriod",
        "PrepaidExpensesTurnoverPeriod", "Ratios", "CalendarOneYear", "Revenue",
    ],
    "IS": [
        "BalanceSheet", "Revenue", "CostOfSales", "GrossProfit", "SellingGeneralAdministrativeExpenses",
        "OperatingIncome", "FinanceIncome", "FinancialExpenses", "ProfitBeforeTax", "IncomeTaxExpense", "Profit",
        "IncomeStatement", "CostOfSalesRatio", "SellingGeneralAdministrativeRatio",
        "SalesAndSellingGeneralAdministrativeRatio", "IncomeTaxRatio", "ProfitRatio", "Ratios",
    ],
}

# ---------------------------------------------------------------------------
# FIXED VALUES — lexicon (kind, word, tag, desc), in file order per kind.
# ---------------------------------------------------------------------------
LEXICON_YEAR = [
    ("first", "REL"), ("second", "REL"), ("third", "REL"), ("latest", "REL"), ("previous", "PAST"),
    ("tax", "PAST"), ("recent", "PAST"), ("preceding", "PAST"), ("fiscal", "PAST"), ("calendar", "PAST"),
    ("past", "PAST"), ("financial", "PAST"), ("last", "PAST"), ("upcoming", "FUTURE"), ("next", "FUTURE"),
    ("current", "REL"), ("coming", "FUTURE"), ("following", "FUTURE"), ("present", "FUTURE"), ("future", "FUTURE"),
]
LEXICON_QUARTER = [
    ("1st", "REL"), ("2nd", "REL"), ("3rd", "REL"), ("4th", "REL"), ("first", "REL"),
    ("second", "REL"), ("third", "REL"), ("fourth", "REL"), ("recent", "PAST"), ("fiscal", "PAST"),
    ("previous", "PAST"), ("past", "PAST"), ("final", "REL"), ("last", "PAST"), ("next", "FUTURE"),
    ("upcoming", "FUTURE"), ("following", "FUTURE"), ("coming", "FUTURE"), ("present", "FUTURE"), ("current", "FUTURE"),
]
LEXICON_WORDS = [
    ("increase", "UP"), ("increases", "UP"), ("increased", "UP"), ("rise", "UP"), ("rose", "UP"),
    ("grow", "UP"), ("grew", "UP"), ("fall", "DOWN"), ("fell", "DOWN"), ("drop", "DOWN"),
    ("dropped", "DOWN"), ("decrease", "DOWN"), ("decreases", "DOWN"), ("decreased", "DOWN"), ("decline", "DOWN"),
    ("declined", "DOWN"), ("reduce", "DOWN"), ("reduced", "DOWN"), ("change", "DOWN"), ("shrink", "DOWN"),
]
# The dialog adds one time word of its own.
EXTRA_TIME_WORDS = [("this", "PAST")]

# FIXED VALUES — ordinal words per quarter (no match -> quarter 4).
QUARTER_ORDINALS = [
    (1, "first"), (1, "1st"),
    (2, "second"), (2, "2nd"),
    (3, "third"), (3, "3rd"),
    (4, "fourth"), (4, "4th"), (4, "final"),
]
# FIXED VALUES — time words that are too unspecific before "quarter".
UNSPECIFIC_QUARTER_WORDS = ["tax", "fiscal", "financial", "calendar"]

# ---------------------------------------------------------------------------
# FIXED VALUES — label maps.
# ---------------------------------------------------------------------------
INTENT_LABELS = [("None", 0), ("IF.fact", 1), ("IF.forecast", 2), ("PAST.value", 3)]
SPECIAL_TAG_LABELS = [("[UNK]", 100), ("[SEP]", 102), ("[PAD]", 0), ("[CLS]", 101), ("[MASK]", 103)]
ENTITY_TAGS = ["APPLY", "BS", "IS", "PERCENT", "TIME"]
TAG_ID_OFFSET = 5  # "O" = 5, then B-/I- pairs in ENTITY_TAGS order

# ---------------------------------------------------------------------------
# FIXED VALUES — utterance templates and markers.
# ---------------------------------------------------------------------------
ENTITY_START = "[E]"
ENTITY_END = "[/E]"
TEMPLATE_PAST = "{} is the {} in the {}?"
TEMPLATES_WHATIF = [
    "what happens to the {} when the {} {} by {} in the {}?",
    "what will be the effect to {} if the {} {} by {} in the {}?",
    "when the {} {} by {} in the {}, what will happen to the {}?",
    "if the {} {} by {} in the {}, what will be the effect to {}?",
]
TEMPLATE_FORECAST = "{} will be the {} in the {}?"
QUESTION_WORDS = ["what", "how"]
PERCENT_WORDS = ["percent", "%"]
TIME_UNITS = ["year", "quarter"]

# ---------------------------------------------------------------------------
# FIXED VALUES — report codes and the period-label words of filings.
# term number = 47 + (business year - 2015)
# ---------------------------------------------------------------------------
REPORT_CODES = [
    ("11011", "", "4Q"),
    ("11013", " 1분기", "1Q"),
    ("11012", " 반기", "2Q"),
    ("11014", " 3분기", "3Q"),
]
PERIOD_LABEL_PREFIX = "제 "
PERIOD_LABEL_SUFFIX = " 기"
PERIOD_LABEL_END = "말"
TERM_BASE_YEAR = 2015
TERM_BASE_NUMBER = 47

# FIXED VALUES — graph export node size by account level.
LEVEL_NODE_SIZE = [(0, 20), (1, 18), (2, 16), (3, 14), (4, 12), (5, 10), (98, 12), (99, 10)]

# FIXED VALUES — forecast scale and focal-loss parameters.
FORECAST_SCALE = 1e13
FOCAL_ALPHA = 0.75
FOCAL_GAMMA = 3.0
DAYS_PER_YEAR = 365
