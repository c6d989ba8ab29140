"""Streaming.

The point-of-sale analysis works on a closed batch (one period of sales), and none of its steps
keeps state across arriving data, so there is no streaming operator here. Every operator is a
DataFrame → DataFrame function and can be applied inside ``foreachBatch`` if sales arrive as a
stream.
"""
