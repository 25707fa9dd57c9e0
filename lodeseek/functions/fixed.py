"""The engine's results depend on exactly these lists, in this order. They are data, not rules to tune."""

from __future__ import annotations


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


def _lines(text: str) -> tuple[str, ...]:
    return tuple(line.strip() for line in text.strip().splitlines())


# Fixed: words that the index leaves out.
STOP_WORDS = _words("""
    a an the
    i me my myself we our ours ourselves you your yours yourself yourselves
    he him his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those
    am is are was were be been being have has had having do does did doing
    would should could ought might must shall will can
    at by for from in into of on to with about against between through during before after
    above below up down out off over under
    and but if or because as until while although though unless since when where why how
    all each every both few more most other some such no nor not only own same so
    than too very just also now here there then
    need any many much even back well way want get got go going make made like
    http https www com org net html htm
""")

# Fixed: Porter's suffixes of steps 2 and 3 with their replacements, and of step 4; the first that ends a word is taken.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = _words("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize")

# Fixed: phrases that count for machine-generated prose.
PHRASES = _lines("""
    delve
    delves
    delving
    tapestry
    multifaceted
    nuanced
    comprehensive
    crucial
    vital
    realm
    landscape
    paradigm
    leverage
    leveraging
    utilize
    utilizing
    foster
    fostering
    facilitate
    enhance
    enhancing
    optimal
    robust
    seamless
    streamline
    pivotal
    intricate
    myriad
    plethora
    pertaining
    it's important to note
    it is important to note
    it's worth noting
    it is worth noting
    in today's world
    in this day and age
    at the end of the day
    when it comes to
    in terms of
    on the other hand
    that being said
    having said that
    it goes without saying
    in conclusion
    to summarize
    to sum up
    in summary
    all in all
    overall
    let's dive in
    let's explore
    let's delve
    this article will
    this guide will
    in this article
    in this guide
    in this post
    welcome to this
    it's essential
    it is essential
    play a crucial role
    plays a crucial role
    of paramount importance
""")

# Fixed: what paragraphs of such prose begin with; of several that fit, the first here is recorded.
STARTERS = _lines("""
    furthermore
    additionally
    moreover
    however
    consequently
    nevertheless
    subsequently
    therefore
    thus
    hence
    in addition
    as a result
    for instance
    for example
    in fact
    indeed
    notably
    importantly
    specifically
    particularly
    firstly
    secondly
    thirdly
    finally
    lastly
    to begin
    to start
    moving on
    next
    now
""")

# Fixed: file endings and substrings that mark an URL as not worth crawling.
EXTENSIONS = _words("""
    pdf zip tar gz rar 7z exe dmg msi deb rpm jpg jpeg png gif svg ico webp mp3 mp4 avi mov wmv flv
    doc docx xls xlsx ppt pptx css js json xml rss atom woff woff2 ttf eot
""")
LOW_VALUE = _words("""
    /login /logout /signin /signout /signup /register /password /forgot /reset /account /profile /settings /preferences
    /print /share /email /export /download /subscribe /unsubscribe /feed
    /forks /stargazers /watchers /network /graphs /pulse /compare /commits
    /wiki/special: /wiki/talk: /wiki/user: /wiki/wikipedia: /wiki/file: /wiki/template: /wiki/category: /wiki/portal: /wiki/help:
    action=edit action=history oldid= /share? utm_ fbclid= gclid= /search /archive/ /comment /reply /vote
""")

# Fixed: elements whose text is not shown.
INVISIBLE = ("script", "style", "noscript", "template", "head", "meta", "link")

# Fixed: the words before a date that say what it dates.
PUBLISHED_WORDS = ("published", "posted", "written", "authored")
LABEL_WORDS = ("date", "updated", "modified", "last updated", "last modified")
