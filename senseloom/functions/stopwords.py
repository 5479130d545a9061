"""Words that are never targets nor substitutes."""

# English function words, lower-cased, in their usual order.
STOP_WORDS = tuple(
    """ourselves hers between yourself but again there about once during out very having with they own an be some for do its yours such
    into of most itself other off is am or who as from him each the themselves until below are we these your his through don nor me were her
    more himself this down should our their while above both up to ours had she all no when at any before them same and been have in will on
    does then that because what over why so did not now under he you herself has just where too only myself which those after few whom being
    if theirs my against by doing it how further was here than""".split()
)
