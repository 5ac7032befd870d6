"""Section classification rules.

A rule is ``(type, priority, minimum confidence, [(field, test, weight), ...])``. Fields: ``tag`` (equals),
``classes`` and ``id`` (case-insensitive words), ``has`` (any of the content facts), ``has_all``, ``style``,
``start_y`` (range). Users add rows to the list; order does not matter, priority decides.
"""

LANDMARKS = ["header", "nav", "main", "section", "article", "aside", "footer"]
#: Elements that are sections when their attributes say so; elements with a hyphen in their name are containers too.
CONTAINERS = ["div", "form", "ul", "ol", "dl", "table", "fieldset", "figure", "details", "dialog", "blockquote", "menu", "hgroup", "address"]
# Roles, and parts of class names, ids and data attributes that make a container a section.
SECTION_ROLES = ["banner", "navigation", "main", "complementary", "contentinfo", "region", "search", "form"]
SECTION_CLASSES = [
    "section", "hero", "feature", "cta", "call-to-action", "testimonial", "pricing", "about", "contact", "gallery", "footer", "bottom", "banner", "nav",
    "review", "portfolio", "block", "container", "wrapper", "component", "module",
]
SECTION_IDS = ["hero", "feature", "pricing", "contact", "about", "gallery"]
SECTION_DATA = ["data-section", "data-component", "data-block"]

# Type, priority, minimum confidence, weighted conditions.
SECTION_RULES = [
    ("hero", 110, 0.5, [("classes", "hero|banner|jumbotron|masthead", 0.4), ("has", ["h1"], 0.3), ("has", ["button"], 0.2), ("style", ["image", "gradient"], 0.1)]),
    ("hero", 105, 0.5, [("id", "hero|banner", 0.5), ("has", ["h1"], 0.3), ("has", ["button"], 0.2)]),
    ("hero", 100, 0.6, [("start_y", (0, 200), 0.3), ("has", ["h1"], 0.35), ("has", ["button"], 0.25), ("style", ["image", "gradient"], 0.1)]),
    ("footer", 100, 0.5, [("tag", "footer", 0.8), ("has", ["links"], 0.2)]),
    ("footer", 98, 0.5, [("classes", "footer|site-footer", 0.8), ("has", ["links"], 0.2)]),
    ("footer", 96, 0.5, [("has", ["copyright"], 1.0)]),
    ("footer", 94, 0.5, [("classes", "bottom", 0.5), ("has", ["copyright"], 0.5)]),
    ("navigation", 95, 0.5, [("tag", "nav", 0.6), ("has", ["links"], 0.4)]),
    ("navigation", 93, 0.5, [("tag", "header", 0.3), ("has", ["links"], 0.4), ("start_y", (0, 100), 0.3)]),
    ("navigation", 90, 0.5, [("classes", "nav|menu|navigation|navbar", 0.5), ("has", ["links"], 0.5)]),
    ("pricing", 88, 0.5, [("classes", "pricings?|prices?|plans?|packages?|subscriptions?", 0.8), ("has", ["button"], 0.2)]),
    ("pricing", 85, 0.5, [("id", "pricings?|prices?|plans?", 0.8), ("has", ["button"], 0.2)]),
    ("gallery", 85, 0.5, [("classes", "gallery|portfolio|showcase", 1.0)]),
    ("gallery", 83, 0.5, [("id", "gallery|portfolio|showcase", 0.8), ("has", ["images2"], 0.2)]),
    ("gallery", 80, 0.5, [("has", ["images4"], 1.0)]),
    ("testimonial", 82, 0.5, [("classes", "testimonials?|reviews?|quotes?|customers?|feedback", 0.7), ("has", ["images"], 0.3)]),
    ("testimonial", 78, 0.5, [("id", "testimonials?|reviews?", 0.7), ("has", ["images"], 0.3)]),
    ("about", 78, 0.5, [("classes", "about|company|who-we-are|our-story", 1.0)]),
    ("about", 76, 0.5, [("classes", "team|our-team|story", 1.0)]),
    ("about", 74, 0.5, [("id", "about|company|team", 0.7), ("has", ["headings"], 0.3)]),
    ("cta", 75, 0.5, [("classes", "cta|call-to-action|action|signup", 0.6), ("has", ["button"], 0.4)]),
    ("cta", 72, 0.5, [("id", "cta|action|signup", 0.6), ("has", ["button"], 0.4)]),
    ("contact", 73, 0.5, [("classes", "contact|get-in-touch|reach", 1.0)]),
    ("contact", 71, 0.5, [("id", "contact|reach", 0.8), ("has", ["button"], 0.2)]),
    ("contact", 70, 0.5, [("has", ["email"], 0.6), ("has", ["button"], 0.4)]),
    ("feature", 70, 0.5, [("classes", "features?|benefits?|services?", 0.5), ("has", ["headings"], 0.3), ("has", ["images"], 0.2)]),
    ("feature", 68, 0.5, [("classes", "grid|column", 0.4), ("has", ["headings2"], 0.3), ("has", ["images2"], 0.3)]),
    ("feature", 65, 0.6, [("has_all", ["headings2", "images2"], 0.7), ("has", ["paragraphs"], 0.3)]),
    ("partners", 63, 0.5, [("classes", "partners?|clients?|sponsors?|trusted", 0.8), ("has", ["images"], 0.2)]),
    ("partners", 61, 0.5, [("id", "partners?|clients?|sponsors?", 0.8), ("has", ["images2"], 0.2)]),
    ("partners", 60, 0.5, [("classes", "logos?|brands?", 0.6), ("has", ["images4"], 0.4)]),
    ("portfolio", 60, 0.5, [("classes", "portfolio|works?|projects?|case-study|case-studies", 0.8), ("has", ["images"], 0.2)]),
    ("portfolio", 58, 0.5, [("id", "portfolio|works?|projects?", 0.8), ("has", ["images2"], 0.2)]),
    ("portfolio", 57, 0.5, [("classes", "case|achievements?", 0.6), ("has", ["headings"], 0.2), ("has", ["images"], 0.2)]),
    ("team", 57, 0.5, [("classes", "team|members?|people|staff|leadership", 0.8), ("has", ["images"], 0.2)]),
    ("team", 55, 0.5, [("id", "team|members?|people", 0.8), ("has", ["images2"], 0.2)]),
    ("team", 54, 0.5, [("classes", "executives?|founders?|crew", 0.6), ("has", ["headings"], 0.2), ("has", ["images"], 0.2)]),
    ("stories", 54, 0.5, [("classes", "story|stories|case-study|case-studies|success", 0.8), ("has", ["headings"], 0.2)]),
    ("stories", 52, 0.5, [("id", "story|stories|cases?|success", 0.8), ("has", ["paragraphs"], 0.2)]),
    ("stories", 51, 0.5, [("classes", "examples?|highlights?", 0.6), ("has", ["headings"], 0.2), ("has", ["paragraphs"], 0.2)]),
    ("research", 51, 0.5, [("classes", "research|study|studies|insights?|findings?", 0.8), ("has", ["headings"], 0.2)]),
    ("research", 49, 0.5, [("id", "research|study|studies|insights?", 0.8), ("has", ["paragraphs"], 0.2)]),
    ("research", 48, 0.5, [("classes", "reports?|analytics?|data", 0.6), ("has", ["headings"], 0.2), ("has", ["images"], 0.2)]),
    ("subscribe", 48, 0.5, [("classes", "subscribe|newsletter|mail-?list|sign-?up", 0.8), ("has", ["button"], 0.2)]),
    ("subscribe", 46, 0.5, [("id", "subscribe|newsletter|mail-?list", 0.8), ("has", ["button"], 0.2)]),
    ("subscribe", 45, 0.5, [("classes", "email|updates?|notify", 0.5), ("has", ["email"], 0.3), ("has", ["button"], 0.2)]),
    ("stats", 45, 0.5, [("classes", "stats?|statistics?|numbers?|metrics?", 0.8), ("has", ["headings"], 0.2)]),
    ("stats", 43, 0.5, [("id", "stats?|statistics?|numbers?", 0.8), ("has", ["headings"], 0.2)]),
    ("stats", 42, 0.5, [("classes", "counters?|achievements?|figures?", 0.6), ("has", ["headings2"], 0.4)]),
    ("faq", 42, 0.5, [("classes", "faq|frequently|questions?|help", 0.8), ("has", ["headings"], 0.2)]),
    ("faq", 40, 0.5, [("id", "faq|questions?|help", 0.8), ("has", ["headings"], 0.2)]),
    ("faq", 39, 0.5, [("classes", "accordion|collapse|q-?and-?a", 0.6), ("has", ["headings2"], 0.2), ("has", ["paragraphs"], 0.2)]),
]
