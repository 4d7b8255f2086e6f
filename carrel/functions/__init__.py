"""carrel.functions"""
