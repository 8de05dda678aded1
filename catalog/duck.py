"""SQL fragments shared by the DuckDB oracles."""

SPACE = r"[\s\x0B\x85\p{Z}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def norm(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+', 0)"


def fields(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda f: f <> '')"


def numtok(x: str) -> str:
    return (f"list_transform(regexp_extract_all(replace({x}, ',', ''), '[0-9]+\\.?[0-9]*', 0), "
            "lambda t: rtrim(t, '.'))")


def grams(x: str, n: int = 8) -> str:
    # The one-element list binds the words once; a bare expression would run per run.
    return (f"(list_transform([{norm(x)}], lambda w: list_distinct(list_transform(range(1, len(w) - {n - 2}), "
            f"lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')))))[1]")


def quoted(x: str) -> str:
    return f"nullif(regexp_extract({x}, '(?s)''(.+)''', 1), '')"


CAP = (r"(?i)(?:at most|no more than|no longer than|max(?:imum)?(?: of)?|within|under) "
       r"([0-9]+|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fifteen|twenty) words")
CONTRAST = (r"(?i)\b(but|however|although|though|despite|yet|while|outweigh|balanced|on the other hand)\b")
PRAISE = (r"(?i)\b(praise[sd]?|positives?|good|great|excellent|perfect(?:ly)?|helpful|love[ds]?|liked|"
          r"enjoy(?:ed)?|impress(?:ed|ive)|gorgeous|beautiful|brilliant|amazing|fantastic|wonderful|intuitive)\b")
UNPRAISE = (r"(?i)\b(?:nothing|not|no|never|hardly|barely|lack(?:s|ed|ing)?(?: of)?)\s+(?:\w+\s+){0,2}?"
            r"(?:praise\w*|positives?|good|great|excellent|perfect\w*|helpful|impressive)\b")
