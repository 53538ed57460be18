"""huestrata.functions"""
