"""Scripted runs of the loop, for its query and its SQL alike."""

GOOD, FAKE, BARE = "The passages say so [arxiv:{source}].", "It is known [arxiv:nowhere].", "It is so."
POOR, SHORT = '{"faithful": false, "issues": "unsupported", "sufficient_context": true}', '{"faithful": true, "issues": "too little", "sufficient_context": false}'
#: Drafts and verdicts of the scripted runs, by the question's number modulo 8; the last draft repeats, later verdicts approve.
RUNS = [
    ([GOOD], []), ([FAKE, GOOD], []), ([GOOD], [SHORT]), ([GOOD], [POOR, POOR, POOR]),
    ([GOOD], ["It reads well.", "It reads well.", "It reads well."]), ([BARE, GOOD], []), ([FAKE], []), ([BARE], []),
]
