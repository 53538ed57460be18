"""huestrata.sources"""
