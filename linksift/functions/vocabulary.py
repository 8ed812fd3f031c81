"""Word lists and rule sets that decide the results."""

# Legitimate hosts. The short list is the first 32 of the long one.
LEGIT_DOMAINS = [
    "google.com", "facebook.com", "amazon.com", "microsoft.com", "apple.com", "netflix.com",
    "github.com", "stackoverflow.com", "wikipedia.org", "linkedin.com", "twitter.com",
    "instagram.com", "youtube.com", "reddit.com", "ebay.com", "walmart.com", "bbc.co.uk",
    "cnn.com", "nytimes.com", "medium.com", "shopify.com", "dropbox.com", "zoom.us", "slack.com",
    "adobe.com", "spotify.com", "paypal.com", "chase.com", "bankofamerica.com", "wellsfargo.com",
    "td.com", "rbc.ca", "uvic.ca", "ubc.ca", "mit.edu", "stanford.edu", "harvard.edu", "gov.ca",
    "canada.ca", "irs.gov", "nhs.uk", "who.int", "arxiv.org", "nature.com", "sciencedirect.com",
    "ieee.org", "docker.com", "kubernetes.io", "python.org", "nodejs.org", "npmjs.com",
    "pypi.org", "rust-lang.org", "golang.org", "stripe.com", "twilio.com", "cloudflare.com",
    "fastly.com", "heroku.com", "vercel.com", "netlify.com", "railway.app", "notion.so",
    "figma.com", "canva.com", "trello.com", "airbnb.com", "booking.com", "expedia.com",
    "tripadvisor.com", "uber.com", "lyft.com", "doordash.com", "grubhub.com", "zillow.com",
    "realtor.com", "craigslist.org", "etsy.com", "target.com", "bestbuy.com", "costco.com",
    "homedepot.com",
]
SHORT_LEGIT_DOMAINS = LEGIT_DOMAINS[:32]

# Legitimate paths. The short list is the first 20 of the long one.
LEGIT_PATHS = [
    "/", "/about", "/contact", "/products", "/services", "/help", "/support", "/login",
    "/account", "/settings", "/news", "/blog", "/docs", "/api", "/pricing", "/careers", "/team",
    "/faq", "/terms", "/privacy", "/search", "/explore", "/trending", "/popular", "/new",
    "/dp/B08N5WRWNW", "/python/cpython", "/user/repos", "/watch?v=dQw4w9WgXcQ",
    "/r/programming", "/p/12345",
]
SHORT_LEGIT_PATHS = LEGIT_PATHS[:20]

# Legitimate subdomains.
LEGIT_SUBDOMAINS = [
    "www", "blog", "docs", "help", "api", "mail", "app", "dev", "staging", "cdn", "static", "m",
    "store", "shop", "support", "status", "my",
]
SHORT_LEGIT_SUBDOMAINS = ["blog", "docs", "help", "api", "mail"]

# Protocols; the long legitimate list is weighted 8 : 4 : 1.
LEGIT_PROTOCOLS = ["https://"] * 8 + ["https://www."] * 4 + ["http://"]
SHORT_LEGIT_PROTOCOLS = ["https://", "https://www."]
PHISHING_PROTOCOLS = ["http://", "https://", "http://www."]

# Search terms in legitimate queries.
SEARCH_TERMS = ["weather", "news", "python", "recipe", "how+to"]

# Phishing words. The short brand list is the first 10 of the long one.
PHISHING_KEYWORDS = [
    "secure", "verify", "update", "confirm", "login", "account", "banking", "signin",
    "authenticate", "validate", "password", "credential", "alert", "suspended", "locked",
]
PHISHING_BRANDS = [
    "paypal", "apple", "google", "microsoft", "amazon", "netflix", "chase", "wellsfargo",
    "bankofamerica", "facebook", "instagram", "linkedin", "dropbox", "adobe", "spotify",
]
SHORT_PHISHING_BRANDS = PHISHING_BRANDS[:10]
PHISHING_TLDS = [
    ".xyz", ".tk", ".ml", ".ga", ".cf", ".gq", ".top", ".club", ".online", ".site", ".info",
    ".ru", ".cn", ".buzz", ".link", ".click",
]
PHISHING_PATHS = [
    "/verify-account", "/secure-login", "/update-info", "/confirm-identity", "/reset-password",
    "/unlock-account", "/validate-user", "/security-check", "/auth/login", "/account/verify",
    "/signin/confirm", "/secure/update",
]
JOINERS = ["-", ".", ""]
FAKE_EXTENSIONS = [".com", ".org", ".net"]

# Rules of the lexical features.
SUSPICIOUS_TLDS = [
    ".xyz", ".tk", ".ml", ".ga", ".cf", ".gq", ".top", ".club", ".online", ".site", ".buzz",
    ".link", ".click",
]
SPECIAL_CHARACTERS = "!#$%^&*()=+[]{}|;:',<>?"
RISK_WORDS = ["login", "verify", "secure", "account", "update"]

# Feature names in their normative order, with the names shown in charts.
FEATURE_TITLES = {
    "url_length": "URL length",
    "domain_length": "Domain length",
    "path_length": "Path length",
    "num_dots": "Number of dots",
    "num_hyphens": "Hyphens in domain",
    "num_subdomains": "Number of subdomains",
    "has_https": "Uses HTTPS",
    "has_ip": "Has IP address",
    "has_at_symbol": "Has @ symbol",
    "num_special_chars": "Special characters",
    "digits_in_domain": "Digits in domain",
    "suspicious_tld": "Suspicious TLD (.xyz etc)",
    "has_login": 'Contains "login"',
    "has_verify": 'Contains "verify"',
    "has_secure": 'Contains "secure"',
    "has_account": 'Contains "account"',
    "has_update": 'Contains "update"',
    "has_query": "Has query params",
}
FEATURES = list(FEATURE_TITLES)

# Column names of the 48-feature page table.
PAGE_FEATURES = [
    "NumDots", "SubdomainLevel", "PathLevel", "UrlLength", "NumDash", "NumDashInHostname",
    "AtSymbol", "TildeSymbol", "NumUnderscore", "NumPercent", "NumQueryComponents",
    "NumAmpersand", "NumHash", "NumNumericChars", "NoHttps", "RandomString", "IpAddress",
    "DomainInSubdomains", "DomainInPaths", "HttpsInHostname", "HostnameLength", "PathLength",
    "QueryLength", "DoubleSlashInPath", "NumSensitiveWords", "EmbeddedBrandName",
    "PctExtHyperlinks", "PctExtResourceUrls", "ExtFavicon", "InsecureForms",
    "RelativeFormAction", "ExtFormAction", "AbnormalFormAction",
    "PctNullSelfRedirectHyperlinks", "FrequentDomainNameMismatch", "FakeLinkInStatusBar",
    "RightClickDisabled", "PopUpWindow", "SubmitInfoToEmail", "IframeOrFrame", "MissingTitle",
    "ImagesOnlyInForm", "SubdomainLevelRT", "UrlLengthRT", "PctExtResourceUrlsRT",
    "AbnormalExtFormActionR", "ExtMetaScriptLinkRT", "PctExtNullSelfRedirectHyperlinksRT",
]

# Shown risk flags. A number above its limit is a warning.
RISK_LIMITS = [
    ("URL Length", "url_length", 75),
    ("Domain Length", "domain_length", 30),
    ("Dots in URL", "num_dots", 3),
    ("Domain Hyphens", "num_hyphens", 1),
]
# Shown yes-or-no flags with the class of each answer.
RISK_MARKS = [
    ("HTTPS", "has_https", "good", "bad"),
    ("IP Address", "has_ip", "bad", "good"),
    ("Suspicious TLD", "suspicious_tld", "bad", "good"),
    ("Has 'login'", "has_login", "warn", ""),
    ("Has 'secure'", "has_secure", "warn", ""),
    ("Has 'verify'", "has_verify", "warn", ""),
]
