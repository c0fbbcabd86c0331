"""State from one run to the next.

Inspection is continuous by running again, not by an open stream: the history
holds a high-water mark per table, and the next run looks at what came after it.
"""
