"""Fixed word lists, weights and patterns of the text operators."""

# Emoji weights.
BULLISH_EMOJI = {"🚀": 3, "🌙": 2, "💎": 2, "🐂": 2, "📈": 1, "💰": 1, "🔥": 1, "⬆️": 1, "🟢": 1}
BEARISH_EMOJI = {"🐻": 3, "📉": 2, "🧸": 2, "💥": 1, "⬇️": 1, "🔴": 1, "😱": 1, "💸": 1}

# Momentum words and weights.
MOMENTUM = {
    "breakout": 2.0, "moon": 2.5, "squeeze": 2.0, "rally": 1.5, "pump": 1.8, "surge": 1.5, "rocket": 2.0,
    "explode": 1.8, "takeoff": 1.5, "momentum": 1.0, "crash": -2.0, "dump": -2.5, "collapse": -2.0, "tank": -1.8,
    "drill": -1.5, "free fall": -2.0, "plummet": -1.8, "sideways": -0.5, "flat": -0.3, "stagnant": -0.5,
    "consolidation": 0.2, "support": 0.5, "resistance": -0.3,
}

# Due-diligence quality indicators.
DD_WORDS = {
    "financial statements": 3, "balance sheet": 3, "income statement": 3, "cash flow": 3, "earnings": 2, "revenue": 2,
    "profit margin": 2, "debt to equity": 2, "pe ratio": 1, "market cap": 1, "valuation": 2, "competitors": 1,
    "industry analysis": 2, "management": 1, "insider trading": 2, "institutional ownership": 1,
}
DD_TITLE_WORDS = ("dd", "due diligence", "analysis", "research", "deep dive")
DD_SHORT_WORDS = ("revenue", "earnings", "pe ratio", "debt", "cash flow", "valuation")

# Option vocabulary.
OPTION_WORDS = ("calls", "puts", "strike", "expiry", "otm", "itm", "premium", "theta", "delta", "gamma", "vega", "iv",
                "implied volatility", "yolo", "fd", "weeklies")

# News impact words and weights, sector words, source tiers.
IMPACT = {
    "earnings": 3, "revenue": 2, "profit": 2, "loss": 2, "acquisition": 3, "merger": 3, "buyout": 3, "ipo": 2,
    "listing": 1, "delisting": 2, "fda approval": 3, "drug approval": 3, "clinical trial": 2, "lawsuit": 2,
    "settlement": 1, "investigation": 2, "recall": 2, "bankruptcy": 3, "restructuring": 2, "dividend": 1,
    "stock split": 1, "buyback": 1, "guidance": 2, "outlook": 2, "forecast": 2, "ceo": 2, "management": 1,
    "resignation": 2, "partnership": 1, "contract": 1, "deal": 1,
}
SECTOR_WORDS = {
    "technology": ("tech", "software", "ai", "cloud", "digital", "cyber"),
    "finance": ("bank", "financial", "fintech", "payment", "credit", "lending"),
    "healthcare": ("pharma", "biotech", "medical", "health", "drug", "vaccine"),
    "energy": ("oil", "gas", "renewable", "solar", "wind", "electric"),
    "retail": ("retail", "consumer", "e-commerce", "shopping", "brand"),
    "automotive": ("auto", "car", "vehicle", "tesla", "electric vehicle"),
    "real_estate": ("real estate", "reit", "property", "housing", "construction"),
}
SOURCE_TIERS = {
    1.0: ("reuters", "bloomberg", "wall street journal", "financial times"),
    0.8: ("cnbc", "marketwatch", "yahoo finance", "seeking alpha"),
    0.6: ("benzinga", "the motley fool", "investopedia"),
}
OTHER_TIER = 0.4

# Ticker patterns, crypto names, words that are no tickers, well-known tickers.
CRYPTO = ("BTC", "ETH", "BNB", "ADA", "SOL", "DOGE", "MATIC", "DOT", "AVAX", "LINK")
SYMBOL_PATTERNS = (
    r"\$([A-Z]{1,5})\b",
    r"\b([A-Z]{2,5})\s*[:|-]",
    r"\(([A-Z]{2,5})\)",
    r"(?:and|&)\s+([A-Z]{2,5})\b",
    r",\s*([A-Z]{2,5})\b",
    r"\b([A-Z]{2,5})\s+(?:stock|shares|calls|puts|options|up|down|moon|rocket|beats|earnings|price|target)",
    r"(?:^|\.\s+)([A-Z]{2,5})\s+(?:is|has|will|to|going|stock|shares)",
)
NOT_TICKERS = (
    "THE", "AND", "FOR", "ARE", "BUT", "NOT", "YOU", "ALL", "CAN", "HER", "WAS", "ONE", "OUR", "OUT", "DAY", "GET",
    "USE", "MAN", "NEW", "NOW", "OLD", "SEE", "WAY", "WHO", "ITS", "DID", "YES", "HIS", "HAS", "HAD", "LET", "PUT",
    "TOO", "END", "HOW", "AIR", "MEN", "OFF", "SET", "OWN", "TAKE", "COME", "WORK", "LIFE", "INTO", "TIME", "VERY",
    "WHAT", "WITH", "HAVE", "FROM", "THEY", "KNOW", "WANT", "BEEN", "GOOD", "MUCH", "SOME", "WOULD", "THERE", "MAKE",
    "WELL", "YEAR", "BACK", "THINK", "FIRST", "STILL", "AFTER", "OTHER", "MANY", "MUST", "OVER", "SUCH", "USED",
    "MOST", "STATE", "EVEN", "MADE", "SCHOOL", "HOUSE", "WORLD", "SMALL", "FOUND", "HERE", "GIVE", "GENERAL",
    "PUBLIC", "HAND", "PART", "PLACE", "CASE", "FACT", "GROUP", "PROBLEM", "RIGHT", "SAME", "SEEM", "TELL", "POINT",
    "ASKED", "WENT", "MONEY", "STORY", "UNTIL", "QUITE", "BEGAN", "MIGHT", "NEVER", "SYSTEM", "ORDER", "DIDN",
    "DOESN", "HAVEN", "WASN", "WEREN", "WOULDN", "SHOULDN", "COULDN", "MUSTN", "ISN", "WON", "CALL", "BUY", "SELL",
    "HOLD", "MOON", "YOLO", "FOMO", "HODL", "DD", "TA", "FA", "IPO", "CEO", "CFO", "USD", "EUR", "GBP", "JPY", "CAD",
)
KNOWN_TICKERS = (
    "AAPL", "MSFT", "GOOGL", "GOOG", "AMZN", "TSLA", "META", "NVDA", "NFLX", "AMD", "INTC", "CRM", "ADBE", "PYPL",
    "SHOP", "UBER", "LYFT", "ROKU", "ZM", "DOCU", "SNOW", "PLTR", "RBLX", "COIN", "HOOD", "SOFI", "CRWD", "OKTA",
    "DDOG", "NET", "TWLO", "SQ", "V", "MA", "JPM", "BAC", "WFC", "GS", "MS", "C", "USB", "PNC", "SPY", "QQQ", "IWM",
    "DIA", "VTI", "VOO", "ARKK", "SQQQ", "TQQQ", "UPRO", "GME", "AMC", "BB", "NOK", "WISH", "CLOV", "SPCE", "TLRY",
    "SNDL", "MVIS",
)
CONTEXT_WORDS = ("stock", "share", "price", "trading", "buy", "sell", "calls", "puts", "earnings", "revenue", "profit",
                 "loss", "bullish", "bearish", "moon", "rocket", "diamond", "hands", "squeeze", "short")

# Politicians, sectors of symbols, policy themes of sectors.
POLITICIANS = {
    "nancy pelosi": ("Democrat", 5, "House"), "paul pelosi": ("Democrat", 3, "Spouse"),
    "chuck schumer": ("Democrat", 5, "Senate"), "mitch mcconnell": ("Republican", 5, "Senate"),
    "kevin mccarthy": ("Republican", 4, "House"), "alexandria ocasio-cortez": ("Democrat", 3, "House"),
    "ted cruz": ("Republican", 3, "Senate"), "elizabeth warren": ("Democrat", 4, "Senate"),
}
SYMBOL_SECTOR = {
    "AAPL": "technology", "MSFT": "technology", "GOOGL": "technology", "AMZN": "technology", "TSLA": "automotive",
    "F": "automotive", "GM": "automotive", "JPM": "finance", "BAC": "finance", "WFC": "finance", "GS": "finance",
    "JNJ": "healthcare", "PFE": "healthcare", "UNH": "healthcare", "MRNA": "healthcare", "XOM": "energy",
    "CVX": "energy", "COP": "energy", "SLB": "energy",
}
SECTOR_THEMES = {"technology": 4, "healthcare": 4, "energy": 4, "finance": 4, "defense": 3, "infrastructure": 3}
