"""huestrata.streaming"""
