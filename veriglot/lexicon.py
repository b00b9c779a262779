"""Word lists, character classes, patterns, thresholds and mappings that the results depend on."""

LANGUAGES = ("es", "en", "nl")

STOPWORDS = {
    "es": "el la de que y en un es se no te lo le da su por son con para una las los del al".split(),
    "en": "the be to of and a in that have i it for not on with he as you do at this but his by from".split(),
    "nl": "de het een en van te dat die in is hij niet zijn op aan met als voor had er maar om hem dan zou".split(),
}
EVIDENCE_WORDS = {
    "es": "el la de que y en un es se no te lo con para una del todo le da su por son pero esto ya muy hacer como fue ser han cuando hasta más desde".split(),
    "en": "the be to of and a in that have it for not on with he as you do at this but his by from they she or an will my one all would there their".split(),
    "nl": "de het een en van te dat die in is hij niet zijn op aan met als voor had er maar om hem dan zou nu wel nog worden bij onder tegen".split(),
}
EVIDENCE_CHARS = {"es": "[ñáéíóúüÑÁÉÍÓÚÜ¿¡]", "en": "[a-zA-Z]", "nl": "[ëïöüÿ]|ij"}
#: Articles before a word, and word endings.
ARTICLES = {"es": ["el", "la", "los", "las"], "en": ["the", "a", "an"], "nl": ["de", "het"]}
ENDINGS = {"es": ["ión", "ado", "ida", "mente"], "en": ["ing", "ed", "ly", "tion"], "nl": ["lijk", "heid", "tie"]}
EVIDENCE_WHITELIST = "email online website app software hardware login logout password username admin user click download upload submit cancel ok google microsoft apple facebook twitter blog podcast streaming wifi smartphone".split()
CAPITAL_EXCEPTIONS = {
    "es": "de del el la y o por para con en".split(),
    "en": "a an the and or but for nor so yet in on at to of".split(),
    "nl": "de het een en van in op aan met voor door".split(),
}

#: Families of placeholders: pattern and, from its first group, what valid content looks like.
PLACEHOLDERS = {
    "curly_braces": (r"\{([^}]*)\}", r"^[a-zA-Z_][a-zA-Z0-9_]*$"),
    "double_curly": (r"\{\{([^}]*)\}\}", r"^[a-zA-Z_][a-zA-Z0-9_.\[\]]*$"),
    "printf_style": (r"(%[sdifgeEGc%])", r"^%[sdifgeEGc%]$"),
    "dollar_braces": (r"\$\{([^}]*)\}", r"^[a-zA-Z_][a-zA-Z0-9_]*$"),
    "colon_params": (r":([a-zA-Z_][a-zA-Z0-9_]*)", r"^[a-zA-Z_][a-zA-Z0-9_]*$"),
    "angle_brackets": (r"<([^>]*)>", r"^[a-zA-Z_][a-zA-Z0-9_\s]*$"),
}
SQUARE_BRACKETS = r"\[([^\]]*)\]"
PLACEHOLDER_WHITELIST = ["{enter}", "{tab}", "{space}", "{click}", "{hover}", "<br>", "<hr>", "<b>", "<i>", "<em>", "<strong>", ":)", ":D", ":(", ":P", ":o"]
CURRENCY = r"([€$£¥₹])\s*(\d[\d\s,.]*)|\b(\d[\d\s,.]*)\s*([€$£¥₹])"
US_NUMBER, EU_NUMBER = r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b", r"\b\d{1,3}(?:\.\d{3})*(?:,\d+)?\b"
US_IN_EU, EU_IN_US = r"\d{1,3}(?:,\d{3})+\.\d+", r"\d{1,3}(?:\.\d{3})+,\d+"

SEVERITY = {"grammar": "warning", "spelling": "error", "style": "info", "placeholder": "error", "language_leak": "error", "punctuation": "warning", "capitalization": "warning", "consistency": "warning"}
VERIFIER_PRIORITY = {"languagetool": 100, "placeholder": 90, "heuristic": 80}
DEFAULT_PRIORITY = 50
GRAMMAR_TYPES = {"TYPOS": "spelling", "GRAMMAR": "grammar", "STYLE": "style", "TYPOGRAPHY": "style", "PUNCTUATION": "punctuation", "CASING": "capitalization", "REPETITION": "style", "REDUNDANCY": "style", "MISC": "grammar"}
GRAMMAR_CODES = {"es": "es", "en": "en-US", "nl": "nl"}

CONTENT_TAGS = "p div span article section main h1 h2 h3 h4 h5 h6 li td th blockquote figcaption label legend option button".split()
INLINE_TAGS = "span a strong em b i u small sup sub".split()
BLOCK_TYPES = {
    "heading": "h1 h2 h3 h4 h5 h6".split(), "list_item": ["li", "dt", "dd"], "table_cell": ["td", "th", "caption"], "quote": ["blockquote", "q"], "caption": ["figcaption"],
    "label": ["label", "legend"], "interactive": ["button", "input"], "paragraph": ["p"], "section": ["article", "section", "main"],
}
SCRIPT_HINTS = ["spa.", "app.", "dashboard.", "admin.", "react", "vue", "angular", "ember", ".js", "client-side", "frontend"]
IGNORED = ("script", "style", "noscript", "meta", "link", "head", ".visually-hidden", ".sr-only", '[aria-hidden="true"]', '[style*="display: none"]', '[style*="visibility: hidden"]')
